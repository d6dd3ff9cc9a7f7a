"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Shingles are runs of five words of the lower-cased whole text (fewer words: all of them). A shingle weighs its count in the text times
   an inverse document frequency: ln((N + 1) / (df + 1)) of the N documents, scaled to lie between FLOOR (in all documents) and 1 (in one),
   in LEVELS steps. FLOOR bounds by how much an edit of a copy can outweigh the text that thousands of copies share: an unscaled
   logarithm would give it ten times the weight, and lose the copy. Document frequencies come from all documents, in ``SLOTS`` hashed
   counters of 64 bits, less what a counter holds on average, so they tell shingles apart that more than words per document / SLOTS of the documents
   hold (some 0.02 %) and take all rarer ones for about as rare. The counters' levels are 2 MB whatever the input.
2. Each text gets SAMPLES weighted samples (two texts agree in one with a probability equal to their weighted Jaccard
   similarity), grouped into BANDS. Equal texts are collapsed first, so a text that a third of all rows repeat is one node.
3. Texts of a band's bucket are candidates, but never all pairs of them: each is paired with the bucket's leader (another one in each band)
   and with its neighbour in the order of the bucket's signatures. A bucket of any size is dealt in bounded parts for that.
4. Pairs are verified on their texts by exact weighted Jaccard similarity of THRESHOLD or more, under the TF-IDF weights or under the counts alone
   (so no copy by the plain measure is lost to the weights); links become components. A leader's text is sent once to every task
   that holds a part of its pairs.
5. Buckets whose members are still in several components are gone through again with other leaders and another order, for ROUNDS or until
   a round finds no further link. That is only to make the last step cheap.
6. Buckets that are still mixed then, whatever the reason, are compared whole: the members outside a bucket's largest component with all of its members, in blocks
   of two cells of at most about CELL texts. A block's similarities are products of matrices; only links leave it. So every two texts
   of a bucket end in one component or have been compared.

Result: one row per document with the least doc_id of its class. Recall: a pair at the threshold of the TF-IDF weights shares a bucket with probability
1 - (1 - 0.8**4)**16 = 0.9998; one at the threshold of counts alone with 0.96 at least, if all that its texts share is in every document and all else
in one (weighted similarity 0.67). Step 6 takes time and sends texts in the order of the square of a family's size, divided by CELL for what it
sends, if its texts share buckets without being copies.

Defined cases: a null text is a class of its own; equal texts, empty ones too, are one class; texts without words match equal texts only;
a null doc_id never names a class unless all of its ids are null; repeated rows are separate rows of one class; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor import scratch
from attestor.llm.components import components
from attestor.llm.filters import marked

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: The least weight, and the number of weights from it to 1.
FLOOR, LEVELS = 0.5, 16
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
CHUNKS = 64
FAN_IN = 256
PART = 50_000
#: Members of a bucket that meet its leader in one task, and pairs of a leader that are verified in one.
SALT = 1024
ROUNDS = 6
#: Texts and bytes of a cell of a bucket that is compared whole; a task holds two.
CELL, CELL_BYTES = 2048, 4 << 20
#: Shingles of more holders in a block are multiplied as dense columns.
RARE = 16
#: Shingles that share a table entry tie; the least hash wins in every text alike, which is a sample of those that tie.
TABLE_BITS = 16
#: Below this similarity under counts the one under TF-IDF weights is below THRESHOLD, as no weight is below FLOOR or over 1.
LEAST = 1 / (1 + (1 / THRESHOLD - 1) / FLOOR) - 1e-9
WEIGHT = 1 - (1 - FLOOR) * np.arange(LEVELS) / (LEVELS - 1)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes and their counts."""
    words = np.fromiter(map(zlib.crc32, text.lower().encode().split()), "u8")
    if not len(words):
        return np.empty(0, "u8"), np.empty(0, "i8")
    n = max(1, len(words) - WORDS + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, "u8")
    for k in range(min(WORDS, len(words))):
        h = (h ^ words[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(32)), return_counts=True)


def slots_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype("i8")


def frequencies(texts: DataFrame) -> np.ndarray:
    """The level of every counter, 0 for the rarest, of SLOTS bytes. ``texts``: text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, waiting, held = np.zeros(SLOTS, "u4"), 0, [], 0  # of one task
        for batch in batches:
            for t in batch.column(0):
                docs += 1
                waiting.append(slots_of(shingles(t.as_py() or "")[0]))
                held += len(waiting[-1])
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype("u4")
                    waiting, held = [], 0
        if docs:
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype("u4")
            parts = total.reshape(CHUNKS, -1)
            rows = [zlib.compress(p.astype("u8").tobytes(), 1) for p in parts]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int64()), pa.array([docs] * CHUNKS, pa.int64()), pa.array(rows, pa.binary())], names=["chunk", "task", "docs", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS // CHUNKS, "u8")
        for b in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(b), "u8")
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "task": pdf["task"][:1] // FAN_IN, "docs": [pdf["docs"].sum()], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk int, task long, docs long, counts binary"
    with scratch.small_batches(texts.sparkSession):
        level = scratch.cut(texts.select("text").mapInArrow(count, schema), "shingle-counts")
    tasks = (level.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:  # a tree of bounded fan-in
        above = scratch.cut(level.groupBy("chunk", F.expr(f"task div {FAN_IN}").alias("part")).applyInPandas(lambda pdf: add(pdf), schema), "shingle-counts")
        scratch.drop(level)
        level, tasks = above, -(-tasks // FAN_IN)
    rows = level.orderBy("chunk").collect()  # CHUNKS rows, 16 MB of counters whatever the input
    scratch.drop(level)
    if not rows:
        return np.zeros(SLOTS, "u1")
    return levels(np.concatenate([np.frombuffer(zlib.decompress(r.counts), "u8") for r in rows]), rows[0].docs)


def levels(counts: np.ndarray, n: int) -> np.ndarray:
    if n < 2:
        return np.zeros(len(counts), "u1")
    df = np.clip(counts - counts.sum() / len(counts), 1, n)
    idf = np.log((n + 1) / (df + 1)) / np.log((n + 1) / 2)
    return np.rint((1 - idf) * (LEVELS - 1)).astype("u1")


def weigh(h: np.ndarray, count: np.ndarray, level: np.ndarray) -> np.ndarray:
    return count * WEIGHT[level[slots_of(h)]]


class Sampler:
    """ICWS with its random variables in tables indexed by hash bits, one multiplier per sample.

    Most shingles occur once in a text, so their weight is one of LEVELS: what they are compared by has a table for each of them.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << TABLE_BITS
        r = rng.gamma(2.0, 1.0, size)
        self.r, self.inverse, self.beta = (x.astype("f4") for x in (r, 1 / r, rng.random(size) * (1 - 1e-6)))
        self.ln_c = np.log(rng.gamma(2.0, 1.0, size)).astype("f4")
        step = np.floor(np.log(WEIGHT).astype("f4")[:, None] * self.inverse + self.beta)
        self.key = (self.ln_c - self.r * (step - self.beta + 1)).ravel()
        self.step = step.ravel()
        self.factor = rng.integers(0, 2**63, SAMPLES).astype("u8") * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray, count: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The bands of a text as 64-bit integers, four 16-bit samples in each."""
        lanes = np.empty(SAMPLES, "u8")
        own = level[slots_of(h)]
        table = own.astype("u8") << np.uint64(TABLE_BITS)
        odd = np.flatnonzero(count != 1)
        ln_w = np.log(count[odd] * WEIGHT[own[odd]]).astype("f4")[None, :]
        step = max(1, 2_000_000 // max(1, len(h)))
        for a in range(0, SAMPLES, step):
            i = (self.factor[a : a + step, None] * h[None, :]) >> np.uint64(64 - TABLE_BITS)
            i += table
            key = self.key[i]
            if len(odd):
                j = i[:, odd] & np.uint64((1 << TABLE_BITS) - 1)
                r, beta = self.r[j], self.beta[j]
                t = np.floor(ln_w * self.inverse[j] + beta)
                key[:, odd] = self.ln_c[j] - r * (t - beta + 1)
            k = np.argmin(key, axis=1)
            rows = np.arange(len(k))
            steps = self.step[i[rows, k]]
            if len(odd):
                at = np.minimum(np.searchsorted(odd, k), len(odd) - 1)
                steps = np.where(odd[at] == k, t[rows, at], steps)
            x = (h[k] + steps.astype("i8").view("u8") * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            lanes[a : a + step] = x >> np.uint64(48)
        shift = np.array([48, 32, 16, 0], "u8")
        return (lanes.reshape(BANDS, ROWS) << shift).sum(1, dtype="u8").view("i8")


def similarity(a: str, b: str, level: np.ndarray) -> float:
    (ha, ca), (hb, cb) = shingles(a), shingles(b)
    return alike(ha, ca, hb, cb, level) if len(ha) and len(hb) else float(a == b)


def alike(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray, level: np.ndarray) -> float:
    """The greater of the weighted Jaccard similarities under counts and under TF-IDF weights; 0 if the former rules both out."""
    plain = jaccard(ha, ca, hb, cb)
    return max(plain, jaccard(ha, weigh(ha, ca, level), hb, weigh(hb, cb, level))) if plain >= LEAST else 0.0


def jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    low = np.minimum(wa[both], wb[at[both]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def signatures(texts: DataFrame, level: np.ndarray) -> DataFrame:
    """``texts`` (doc_id, key, text) as (doc_id, key, bands); bands are null without words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler()
        for batch in batches:
            bands = []
            for t in batch.column(2):
                h, c = shingles(t.as_py() or "")
                bands.append(sample(h, c, level) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    return texts.select("doc_id", "key", "text").mapInArrow(work, "doc_id long, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, level: np.ndarray) -> DataFrame:
    """``pairs`` (hub, other, salt) with linked: whether their texts (key, text) have the similarity."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out: list[tuple] = []
            for hub, salt, other, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                place, other, mine = (hub.as_py(), salt.as_py()), other.as_py(), shingles(text.as_py())
                if other is None:
                    at, own = place, mine
                elif place != at:
                    raise ValueError("a pair without its hub's text")
                else:
                    out.append((place[0], other, alike(*own, *mine, level) >= THRESHOLD))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["hub", "other", "linked"])

    place = ["hub", "salt"]
    others = pairs.join(texts.select(F.col("key").alias("other"), "text"), "other").select(*place, "other", "text")
    hubs = pairs.select(*place).distinct().join(texts.select(F.col("key").alias("hub"), "text"), "hub").select(*place, F.lit(None).cast("binary").alias("other"), "text")
    rows = others.unionAll(hubs).repartition(*place).sortWithinPartitions(*place, F.col("other").asc_nulls_first())
    found = rows.mapInArrow(work, "hub binary, other binary, linked boolean")
    return found.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "linked")


def _proposed(members: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) with their hub, the other and salt, from members (value, key, bands, n).

    Round 0: each with its bucket's least member, the same one wherever the same texts meet. Later: with a leader that differs from band to
    band and round to round, and with its neighbour in signature order. A bucket meets its leader in parts.
    """
    order = F.lit(0) if round_ == 0 else F.xxhash64(F.lit(round_), "value", "key")
    leaders = members.groupBy("value").agg(F.min(F.struct(order.alias("o"), "key")).getField("key").alias("hub"), F.ceil(F.max("n") / SALT).cast("int").alias("parts"))
    leaders = leaders.select("value", "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    salt = lambda size: F.pmod(F.xxhash64(F.lit(round_), "key"), F.ceil(F.col("n") / size)).cast("int").alias("part")
    pairs = members.select("value", "key", "n", salt(SALT)).join(leaders, ["value", "part"]).select("hub", F.col("key").alias("other"), "n")
    if round_:
        turn = 5 * round_ % BANDS
        turned = F.concat(F.slice("bands", 1 + turn, BANDS), F.slice("bands", 1, turn))
        beside = members.select("value", "key", turned.alias("s"), salt(PART)).withColumn("hub", F.lag("key").over(Window.partitionBy("value", "part").orderBy("s", "key")))
        pairs = pairs.unionAll(beside.select("hub", F.col("key").alias("other"), F.lit(1).cast("long").alias("n")))
    pairs = pairs.where("hub IS NOT NULL AND other <> hub")
    pairs = pairs.groupBy(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")).agg(F.max(F.struct("n", "hub")).alias("h"))
    pairs = pairs.select("a", "b", F.col("h.hub").alias("hub"), F.when(F.col("h.hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"), F.col("h.n").alias("n"))
    return pairs.select("a", "b", "hub", "other", F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / SALT)).cast("int").alias("salt"))


def _common(left: np.ndarray, right: np.ndarray, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Weight shared by each of ``left`` with each of ``right``; entries (doc, feature, x), at most one of a feature in a document."""
    low = np.zeros((len(left), len(right)), "f4")
    place = np.full((2, max(left.max(), right.max()) + 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    sides = []
    for at in place:
        mine = np.flatnonzero(at[doc] >= 0)
        mine = mine[np.argsort(feature[mine], kind="stable")]
        sides.append((feature[mine], at[doc[mine]], x[mine]))
    (lf, ld, lx), (rf, rd, _) = sides
    dense = np.flatnonzero(holders > RARE)
    column = np.full(len(holders), -1)
    column[dense] = np.arange(len(dense))
    for a in range(0, len(dense), 2048):
        width = min(2048, len(dense) - a)
        parts = []
        for f, d, v in ((lf, ld, lx), (rf, rd, np.ones(len(rf)))):
            c = column[f] - a
            here = (column[f] >= 0) & (c >= 0) & (c < width)
            parts.append(np.zeros((len(low) if f is lf else low.shape[1], width), "f4"))
            parts[-1][d[here], c[here]] = v[here]
        low += parts[0] @ parts[1].T
    rare = np.flatnonzero(holders[lf] <= RARE)
    for a in range(0, len(rare), 100_000):
        e = rare[a : a + 100_000]
        start = np.searchsorted(rf, lf[e], "left")
        m = np.searchsorted(rf, lf[e], "right") - start
        other = np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())
        np.add.at(low, (np.repeat(ld[e], m), rd[other]), np.repeat(lx[e], m).astype("f4"))
    return low


def links_within(rows: list[tuple], level: np.ndarray) -> list[tuple]:
    """Links that join the components of a block, a spanning forest of all there are. ``rows``: (key, component, left, right, text); those of the left are compared with those of the right."""
    own = [shingles(r[4]) for r in rows]
    names: dict = {}
    label = np.array([names.setdefault(r[1], len(names)) for r in rows])
    left, right = (np.flatnonzero([r[k] for r in rows]) for k in (2, 3))
    if not len(left) or not len(right) or len(names) < 2:
        return []
    # a shingle that occurs c times is c features, so that the least of two weights is what two texts share
    nth = [np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in own]
    feature = np.concatenate([np.repeat(h, c) + k.astype("u8") * np.uint64(0x9E3779B97F4A7C15) for (h, c), k in zip(own, nth, strict=True)])
    x = np.concatenate([np.repeat(weigh(h, np.ones(len(h)), level), c) for h, c in own])
    doc = np.repeat(np.arange(len(rows)), [c.sum() for _, c in own])
    _, feature, holders = np.unique(feature, return_inverse=True, return_counts=True)
    kept = holders[feature] > 1
    near = np.zeros((len(left), len(right)), bool)
    for v in (x, np.ones(len(x))):
        total = np.bincount(doc, v, len(rows))
        low = _common(left, right, doc[kept], feature[kept], v[kept], holders)
        # what is single precision here is decided by the exact similarity below
        near |= low >= (THRESHOLD - 1e-3) * (total[left][:, None] + total[right][None, :] - low)
    near &= label[left][:, None] != label[right][None, :]
    out = []
    for i in np.flatnonzero(near.any(1)):
        a = left[i]
        for b in right[near[i]]:
            if label[a] != label[b]:
                (ha, ca), (hb, cb) = own[a], own[b]
                if alike(ha, ca, hb, cb, level) >= THRESHOLD:
                    out.append(tuple(sorted((rows[a][0], rows[b][0]))))
                    label[label == label[b]] = label[a]
    return out


def _placed(members: DataFrame, found_nodes: DataFrame | None) -> DataFrame:
    """``members`` with their component c."""
    if found_nodes is None:
        return members.withColumn("c", F.col("key"))
    return members.join(found_nodes, members.key == found_nodes.node, "left").withColumn("c", F.coalesce("component", "key")).drop("node", "component")


def _compared(members: DataFrame, found_nodes: DataFrame | None, texts: DataFrame, level: np.ndarray) -> DataFrame:
    """Links (a, b) between components from comparing mixed buckets whole; buckets of the same members are compared once."""
    placed = _placed(members.select("value", "key"), found_nodes)
    same = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"h{i}") for i in (1, 2)]
    per = placed.groupBy("value", "c").agg(F.count("*").alias("n"), *same)
    buckets = per.groupBy("value").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), *(F.bit_xor(f"h{i}").alias(f"h{i}") for i in (1, 2)), F.max(F.struct("n", "c")).getField("c").alias("largest"))
    buckets = buckets.where("parts > 1 AND n > 2").dropDuplicates(["n", "h1", "h2"]).select("value", "largest")  # two members met in round 0
    rows = placed.join(buckets, "value").join(texts.select("key", F.octet_length("text").alias("bytes")), "key")
    rows = scratch.cut(rows.select("value", "key", "c", "bytes", (F.col("c") == F.col("largest")).alias("main")), "mixed-members")

    def cells(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / CELL), F.ceil(F.coalesce(F.sum(F.when(which, F.col("bytes"))), F.lit(0)) / CELL_BYTES)).cast("int")

    cut = rows.groupBy("value").agg(cells(F.lit(True)).alias("all"), cells(~F.col("main")).alias("rest"), cells(F.col("main")).alias("most"))
    dealt = rows.join(cut, "value").withColumn("one", F.col("all") <= 1).withColumn("part", F.xxhash64(F.lit(99), "key"))
    dealt = dealt.withColumn("cell", F.when(F.col("one"), F.lit(0)).when(F.col("main"), F.col("rest") + F.pmod("part", "most")).otherwise(F.pmod("part", "rest")).cast("int"))
    last = F.when(F.col("one"), F.lit(0)).when(F.col("main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    whole = dealt.withColumn("last", last).join(texts.select("key", "text"), "key")
    whole = whole.select("value", "key", "c", "cell", F.explode(F.sequence(F.lit(0), "last")).alias("other"), "text")
    whole = whole.select("value", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "key", "c", (F.col("cell") <= F.col("other")).alias("l"), (F.col("cell") >= F.col("other")).alias("r"), "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def linked() -> pa.RecordBatch:
            found = links_within(held, level)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for value, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (value, lo, hi) != at:
                    if held:
                        yield linked()
                    at, held = (value, lo, hi), []
                held.append(row)
        if held:
            yield linked()

    with scratch.small_batches(members.sparkSession, 100):
        found = scratch.cut(whole.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi").mapInArrow(work, "a binary, b binary"), "links-within")
    scratch.drop(rows)
    return found


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, kept): the least doc_id of the document's class, and whether the document is the one that stays."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = rows.where("text IS NOT NULL").withColumn("key", F.unhex(F.md5(F.col("text"))))
    level = frequencies(rows.select("text"))
    with scratch.small_batches(docs.sparkSession):
        signed = scratch.cut(signatures(keyed, level), "signatures")
    nodes = scratch.cut(signed.groupBy("key").agg(F.min("doc_id").alias("least")), "nodes")
    bands = signed.where("bands IS NOT NULL").join(nodes, (signed.key == nodes.key) & signed.doc_id.eqNullSafe(nodes.least)).select(signed.key, "bands").dropDuplicates(["key"])
    spread = bands.select("key", F.posexplode("bands").alias("band", "v")).select("key", F.xxhash64("band", "v").alias("value"))
    sizes = scratch.cut(spread.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = scratch.cut(spread.join(sizes, "value"), "bucket-members")
    involved = scratch.cut(met.select("key").distinct().join(nodes, "key"), "involved")
    members = scratch.cut(met.join(bands.join(involved, "key", "left_semi"), "key"), "bucket-signatures")
    k, i = marked(keyed, involved, "key").where("__hit").alias("k"), involved.alias("i")
    texts = scratch.cut(k.join(i, (F.col("k.key") == F.col("i.key")) & F.col("k.doc_id").eqNullSafe(F.col("i.least"))).select("k.key", "k.text").dropDuplicates(["key"]), "candidate-texts")
    scratch.drop(met, sizes)
    tried, found, found_nodes, open_ = None, None, None, members
    for round_ in range(ROUNDS):
        pairs = _proposed(open_, round_)
        if tried is not None:
            side = lambda c, nodes_=found_nodes: nodes_.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
            pairs = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        pairs = scratch.cut(pairs.select("hub", "other", "salt"), "pairs")
        asked, ends = texts, None
        if round_:  # few pairs are left: only their texts are moved
            ends = scratch.cut(pairs.select(F.col("hub").alias("key")).unionAll(pairs.select(F.col("other").alias("key"))).distinct(), "pair-keys")
            asked = texts.join(ends, "key", "left_semi")
        with scratch.small_batches(docs.sparkSession):
            checked = scratch.cut(verified(pairs, asked, level), "checked")
        scratch.drop(pairs, *filter(None, (ends,)), *([open_] if round_ else []))
        new = checked.where("linked").select("a", "b")
        if new.isEmpty():
            break
        tried = checked.select("a", "b") if tried is None else tried.unionAll(checked.select("a", "b"))
        found = new if found is None else found.unionAll(new)
        before, found_nodes = found_nodes, scratch.cut(components(found), "components")
        if before is not None:
            scratch.drop(before)
        mixed = _placed(members, found_nodes).groupBy("value").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("value")
        open_ = scratch.cut(members.join(mixed, "value", "left_semi"), "open-members")
    rest = _compared(members, found_nodes, texts, level)
    if not rest.isEmpty():
        found = rest if found is None else found.unionAll(rest)
        before, found_nodes = found_nodes, scratch.cut(components(found), "components")
        if before is not None:
            scratch.drop(before)
    if found is None:
        named = nodes.select("key", F.col("key").alias("component"), "least")
    else:
        named = nodes.join(found_nodes, nodes.key == found_nodes.node, "left").select("key", F.coalesce("component", "key").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    of_key = scratch.cut(named.join(least, "component").select("key", "class_id", (F.col("least").eqNullSafe(F.col("class_id"))).alias("first")), "classes")
    out = signed.select("doc_id", "key").join(of_key, "key").select("doc_id", "class_id", "key", "first")
    alone = rows.where("text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("key"), F.lit(True).alias("first"))
    return out.unionByName(alone).select("doc_id", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "key")


def dedupe(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class; of rows that repeat its id and text, one."""
    def name(doc_id: Column, text_key: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), F.hex(text_key))))

    stay = scratch.cut(classes(docs, text=text, key=key).where("kept AND key IS NOT NULL").select(name(F.col("doc_id"), F.col("key")).alias("__k")).distinct(), "stay")
    whole = F.col(f"`{text}`").cast("string")
    rows = docs.where(whole.isNotNull()).withColumn("__k", name(F.col(f"`{key}`").cast("long"), F.unhex(F.md5(whole))))
    # one exchange by __k serves the join and what follows; a null text is a class of its own row by row
    once = rows.join(stay, "__k", "left_semi").dropDuplicates(["__k"]).drop("__k")
    return once.unionByName(docs.where(whole.isNull()))
