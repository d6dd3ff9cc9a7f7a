"""Signed policy packs: bounded, strict parsing, checks in fixed order, and registries as small DataFrames. Driver-side: a pack has 64 KiB at most."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
PACK_BYTES = 65_536
SKILL_SET_BYTES = 1_048_576
_VERSION = re.compile(r"^\d+\.\d+\.\d+$")
_FIELDS = {"pack_id", "version", "reviewed_at", "expires_at", "freshness_days", "min_router_version", "max_router_version", "domains", "jurisdictions", "sources", "capabilities"}


class PackError(ValueError):
    pass


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise PackError("duplicate_key")
    return out


def _yaml(raw: bytes) -> object:
    """YAML of plain values: keys don't repeat, dates stay text, and there are no aliases, which could make a small file large."""
    try:
        import yaml
    except ImportError as error:
        raise PackError("yaml_unavailable") from error

    class Strict(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def construct_mapping(self, node, deep=False):
            return _no_repeats([(self.construct_object(k, deep=True), self.construct_object(v, deep=True)) for k, v in node.value])

    Strict.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node))
    try:
        if any(isinstance(token, (yaml.AliasToken, yaml.AnchorToken)) for token in yaml.scan(raw)):
            raise PackError("malformed_pack")
        found = yaml.load(raw, Loader=Strict)
        json.dumps(found, allow_nan=False)
    except (yaml.YAMLError, TypeError, RecursionError) as error:
        raise PackError("malformed_pack") from error
    except ValueError as error:
        raise error if isinstance(error, PackError) else PackError("malformed_pack") from error
    return found


def parse(raw: bytes, suffix: str = ".json") -> dict:
    """A JSON object, or a YAML one by its suffix, of at most PACK_BYTES whose keys don't repeat."""
    if len(raw) > PACK_BYTES:
        raise PackError("pack_too_large")
    if suffix in (".yaml", ".yml"):
        found = _yaml(raw)
        if not isinstance(found, dict):
            raise PackError("malformed_pack")
        return found
    try:
        found = json.loads(raw.decode("utf-8"), object_pairs_hook=_no_repeats, parse_constant=lambda _: (_ for _ in ()).throw(PackError("malformed_pack")))
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as error:
        raise PackError("malformed_pack") from error
    if not isinstance(found, dict):
        raise PackError("malformed_pack")
    return found


def version(text: str) -> tuple[int, ...]:
    if not isinstance(text, str) or not _VERSION.match(text):
        raise PackError("malformed_version")
    return tuple(map(int, text.split(".")))


# Ed25519 (RFC 8032): curve constants.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _add(a, b):
    (x1, y1, z1, t1), (x2, y2, z2, t2) = a, b
    e, g, h, i = (y1 - x1) * (y2 - x2) % _P, (y1 + x1) * (y2 + x2) % _P, 2 * _D * t1 * t2 % _P, 2 * z1 * z2 % _P
    m, n, o, q = g - e, i - h, i + h, g + e
    return m * n % _P, o * q % _P, n * o % _P, m * q % _P


def _times(n: int, point):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (2**255 - 1)
    if y >= _P:
        return None
    x2 = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(x2, (_P + 3) // 8, _P)
    if (x * x - x2) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - x2) % _P or (x == 0 and sign):
        return None
    if x & 1 != sign:
        x = _P - x
    return x, y, 1, x * y % _P


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether an Ed25519 signature holds."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    base_y = 4 * pow(5, -1, _P) % _P
    base = _point(base_y.to_bytes(32, "little"))
    h = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % _L
    left, right = _times(s, base), _add(r, _times(h, a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


def _packed(point) -> bytes:
    x, y, z, _ = point
    inverse = pow(z, -1, _P)
    x, y = x * inverse % _P, y * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _base():
    return _point((4 * pow(5, -1, _P) % _P).to_bytes(32, "little"))


def _scalar(secret: bytes) -> tuple[int, bytes]:
    digest = hashlib.sha512(secret).digest()
    low = int.from_bytes(digest[:32], "little")
    return low & ((1 << 254) - 8) | 1 << 254, digest[32:]


def generate_key() -> tuple[bytes, bytes]:
    """A new secret key and its public one."""
    secret = secrets.token_bytes(32)
    return secret, public_key(secret)


def public_key(secret: bytes) -> bytes:
    if len(secret) != 32:
        raise PackError("invalid_signing_key")
    return _packed(_times(_scalar(secret)[0], _base()))


def sign(secret: bytes, message: bytes) -> bytes:
    """An Ed25519 signature. Not in constant time: for a machine that signs packs, not for a service that strangers can time."""
    own, prefix = _scalar(secret)
    public = public_key(secret)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % _L
    point = _packed(_times(r, _base()))
    h = int.from_bytes(hashlib.sha512(point + public + message).digest(), "little") % _L
    return point + ((r + h * own) % _L).to_bytes(32, "little")


def signed_manifest(raw: bytes, signer: str, secret: bytes, pack_id: str, pack_version: str) -> dict:
    """The manifest that ``check_manifest`` accepts for a pack's bytes."""
    digest = hashlib.sha256(raw).hexdigest()
    message = "\n".join(("1", signer, pack_id, pack_version, digest)).encode()
    return {"schema_version": 1, "signer": signer, "pack_id": pack_id, "version": pack_version, "sha256": digest, "signature": sign(secret, message).hex()}


def check_manifest(raw: bytes, manifest: dict, roots: dict[str, str], pack_id: str, pack_version: str) -> None:
    """Malformed, unknown signer, digest, signature: the first that fails, in this order."""
    fields = ("schema_version", "signer", "pack_id", "version", "sha256", "signature")
    if set(manifest) != set(fields) or manifest["schema_version"] != 1 or manifest["pack_id"] != pack_id or manifest["version"] != pack_version:
        raise PackError("malformed_manifest")
    if manifest["signer"] not in roots:
        raise PackError("unknown_signer")
    if hashlib.sha256(raw).hexdigest() != manifest["sha256"]:
        raise PackError("digest_mismatch")
    message = "\n".join(("1", manifest["signer"], pack_id, pack_version, manifest["sha256"])).encode()
    try:
        good = verify(bytes.fromhex(roots[manifest["signer"]]), message, bytes.fromhex(manifest["signature"]))
    except ValueError:
        good = False
    if not good:
        raise PackError("invalid_signature")


def load(raw: bytes, *, today: date, router: str, manifest: dict | None = None, roots: dict[str, str] | None = None, floors: dict[str, str] | None = None, domain: str | None = None, jurisdiction: str | None = None, unsigned: bool = False, suffix: str = ".json") -> dict:
    """A checked pack: size, syntax, schema, signature, review window, versions, rollback floor, domain, jurisdiction, in this order."""
    pack = parse(raw, suffix)
    if set(pack) != _FIELDS or not all(isinstance(pack[k], list) and pack[k] for k in ("domains", "jurisdictions", "sources")):
        raise PackError("malformed_pack")
    try:
        reviewed, expires = date.fromisoformat(pack["reviewed_at"]), date.fromisoformat(pack["expires_at"])
    except (TypeError, ValueError) as error:
        raise PackError("malformed_pack") from error
    if expires <= reviewed or any(s.get("freshness_days", 0) > pack["freshness_days"] for s in pack["sources"]):
        raise PackError("malformed_pack")
    if manifest is None:
        if not unsigned:
            raise PackError("signature_required")
    else:
        check_manifest(raw, manifest, roots or {}, pack["pack_id"], pack["version"])
    if reviewed > today:
        raise PackError("future_review")
    if expires < today:
        raise PackError("expired_pack")
    if reviewed + timedelta(days=pack["freshness_days"]) < today:
        raise PackError("stale_pack")
    if not version(pack["min_router_version"]) <= version(router) <= version(pack["max_router_version"]):
        raise PackError("incompatible_pack")
    if (floor := (floors or {}).get(pack["pack_id"])) and version(pack["version"]) < version(floor):
        raise PackError("version_rollback")
    if domain is not None and domain not in pack["domains"]:
        raise PackError("domain_not_covered")
    if jurisdiction is not None and "GLOBAL" not in pack["jurisdictions"] and jurisdiction not in pack["jurisdictions"]:
        raise PackError("jurisdiction_not_covered")
    return pack


def registry(spark: SparkSession, packs: Iterable[dict]) -> tuple[DataFrame, DataFrame]:
    """Packs (pack_id, domain) and sources (pack_id, source_id, jurisdictions), sorted, with names unique across packs: all or nothing."""
    ordered = sorted(packs, key=lambda p: p["pack_id"])
    names = [p["pack_id"] for p in ordered] + [s["source_id"] for p in ordered for s in p["sources"]]
    if len(set(names)) != len(names):
        raise PackError("registry_collision")
    domains = [(p["pack_id"], d) for p in ordered for d in p["domains"]]
    sources = [(p["pack_id"], s["source_id"], s["jurisdictions"]) for p in ordered for s in sorted(p["sources"], key=lambda s: s["source_id"])]
    return spark.createDataFrame(domains, "pack_id string, domain string"), spark.createDataFrame(sources, "pack_id string, source_id string, jurisdictions array<string>")
