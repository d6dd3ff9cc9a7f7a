"""The quicker forms of language and advisories against the plain ones, over odd texts."""

import itertools
import re

from pyspark.sql import functions as F

from attestor.functions import text as T


def test_language_and_advisories_are_those_of_the_plain_forms(spark):
    parts = (
        "use CURL now", "curling", "nc", "xnc y", "sync rsync.", "scp\n", "~/.SSH/x", ".env", ".envy", "ID_RSA", "credentials.json", "a.bashrc", ".profile", ".profiles", "base64 then Upload", "send it\nas BASE64", "Base64" + "x" * 81 + "post",
        "Ignore all prior", "do not TELL", "without informing", "disregard this\ninstruction", "the of and que por", "que por para con los las", "The THE Él más tambén también", "ñ ciónthe the", "éthe the of", "ſend base64", "Kurl İgnore prior", "",
    )
    texts = [*parts, *(f"{a} {b}" for a, b in itertools.permutations(parts, 2)), None]
    words = F.regexp_extract_all(F.translate(F.lower("t"), *T.ACCENTS), F.lit("([a-z]+)"), F.lit(1))
    en, es = (F.size(F.filter(words, (lambda m: lambda w: w.isin(*m))(m))) for m in (T.ENGLISH, T.SPANISH))
    clear = (F.greatest(en, es) >= 2) & (F.abs(en - es) >= 2)
    plain = F.array_compact(F.array(*(F.when(F.col("t").rlike(p), F.lit(code)) for code, p in T.ADVISORIES)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.language(F.col("t")), F.when(clear, F.when(en > es, "en").otherwise("es")), T.advisories(F.col("t")), plain).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got) and {r[1] for r in got} == {None, "en", "es"} and {c for r in got for c in r[3]} == {c for c, _ in T.ADVISORIES}


def test_words_are_extracted_once_for_a_language(spark):
    """Each of the two counts used to extract them by itself."""
    plan = spark.range(1).select(T.language(F.concat(F.lit("the of "), F.col("id").cast("string"))).alias("language"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) == 1
