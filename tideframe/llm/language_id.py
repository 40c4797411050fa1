"""Language identification by Bayesian evidence fusion.

Four kinds of evidence give one posterior over the languages: the likelihood of the text under byte n-gram models, the
declared language (markup or metadata), the address suffix, and the host. Declarations are trusted as far as they agree
with the texts: their confusion rates come from counts over all documents. Priors are smoothed hierarchically, a host's
towards its suffix's, that towards the whole table's, so that a host with few pages says little.

Jobs: (1) the languages are the declared values of at least LEAST documents, however large the table; (2) pre-aggregated
n-gram counts by language over all documents; a language whose n-grams weigh less than the smoothing has no model; (3) a map gives each document's log likelihoods, stored with its keys; (4) grouped counts
of the likeliest language by declaration, suffix and host; (5) joins of these with the documents, broadcast only if they
are measured to be small. Hot hosts are pre-aggregated, and their join can be split.

A document is rejected when the posterior of its best language is under SURE, or when its text has no n-gram, or is less
likely under the best language than under random bytes of the same classes. A document with n-grams whose declared
language has no model can't be judged: its declaration is trusted, with confidence 1, and it is never rejected.

Defined results: null or empty text has language "und", confidence 0 and is rejected; null declarations, hosts and
suffixes say nothing; repeated rows get equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import prepare, small, stored
from tideframe.llm.textops import LETTERS, chunks, text_buffers

#: Documents that declare a language which gets a model.
LEAST = 5
#: Hashed n-grams of each length, and the pseudo-count of each bucket.
BUCKETS, GRAMS, SMOOTH = 1 << 13, (2, 3), 0.5
#: A text counts as at most so many independent n-grams.
INDEPENDENT = 60.0
#: Pseudo-documents of the parent in a suffix's and a host's prior, and of agreement in a declaration's rates.
PRIOR, AGREE = 20.0, 8.0
#: Posterior of the best language under which a document is rejected.
SURE = 0.5
UNKNOWN = "und"


def grams(flat: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the n-grams of documents lo..hi-1: letters in lower case with one space between words."""
    b = flat[bounds[lo] : bounds[hi]]
    at = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
    letter = LETTERS[b] & ~((b >= 48) & (b <= 57))
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
    b[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    b, at, letter = b[keep], at[keep], letter[keep]
    for k, n in enumerate(GRAMS):
        m = len(b) - n + 1
        if m <= 0:
            continue
        x, ok = b[:m].copy(), at[:m] == at[n - 1 :]
        for i in range(1, n):
            x = x * np.uint32(0x01000193) + b[i : i + m]
            if i < n - 1:
                ok = ok & letter[i : i + m]
        yield (x[ok] * np.uint32(0x9E3779B1) >> np.uint32(19)).astype(np.int64) + k * BUCKETS, at[:m][ok]


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BUCKETS * len(GRAMS)
        total = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            flat, bounds = text_buffers(batch.column(0))
            label = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()])
            for lo, hi in chunks(bounds):
                here, own = np.unique(label[lo:hi], return_inverse=True)
                for g, d in grams(flat, bounds, lo, hi):
                    found = np.bincount(own[d] * size + g, minlength=len(here) * size).reshape(-1, size)
                    total[here[here >= 0]] += found[here >= 0]
        y, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[y, g])], ["y", "g", "n"])

    return job


def _model(y: tuple, table: pa.Table) -> pa.Table:
    """The log probabilities of one language's n-grams; none where the counts weigh less than the smoothing."""
    counts = np.zeros(BUCKETS * len(GRAMS))
    counts[table.column("g").to_numpy()] = table.column("n").to_numpy()
    known = int(counts.sum() >= SMOOTH * len(counts))
    parts = (counts + SMOOTH).reshape(len(GRAMS), BUCKETS)
    logs = np.log(parts / parts.sum(1, keepdims=True)).ravel()
    return pa.table({"y": pa.array([y[0].as_py()] * known, pa.int32()), "logs": pa.array([logs.tobytes()] * known, pa.binary())})


def _likelihoods(logs: np.ndarray):
    """Mean log likelihoods of a document's n-grams under each language, and the number of its n-grams."""
    table = np.ascontiguousarray(logs.T)  # bucket by language

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            means, counts = [], []
            for lo, hi in chunks(bounds):
                total, n = np.zeros((hi - lo, table.shape[1])), np.zeros(hi - lo)
                for g, d in grams(flat, bounds, lo, hi):
                    n += np.bincount(d, minlength=hi - lo)
                    for k in range(table.shape[1]):
                        total[:, k] += np.bincount(d, table[g, k], hi - lo)
                means += list(total / np.maximum(n, 1)[:, None])
                counts.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(means, pa.list_(pa.float64())), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))],
                ["doc_id", "declared", "host", "suffix", "mean", "grams"],
            )

    return job


def _tally(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Documents of each key by likeliest language."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, "best").agg(F.count("*").alias("n"))
    by = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n")))).alias("by"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0).cast("long"))).alias(f"{key}_n"))


def identify(docs: DataFrame, text: str | Column = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, language, confidence, rejected, posterior) of every row of ``docs``.

    ``posterior`` maps each language to its probability. ``declared``, ``host`` and ``suffix`` are columns of ``docs``.
    """
    prepare(docs.sparkSession)
    nothing = F.lit(None).cast("string")
    plain = lambda c: nothing if c is None else F.when(F.trim(c) != "", F.lower(F.trim(c)))
    tongue = F.regexp_extract(plain(declared), "^[a-z]+", 0)
    rows = docs.select(F.col(key).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"), F.when(tongue != "", tongue).alias("declared"), plain(host).alias("host"), plain(suffix).alias("suffix"))

    said = rows.where("declared is not null").groupBy("declared").count()
    languages = sorted(x["declared"] for x in said.where(F.col("count") >= LEAST).select("declared").collect())
    models = []
    if languages:
        counts = rows.select("text", "declared").mapInArrow(_count(languages), "y int, g int, n long").groupBy("y", "g").agg(F.sum("n").alias("n"))
        models = sorted(counts.groupBy("y").applyInArrow(_model, "y int, logs binary").collect())  # one row of 128 KB for each language
    languages = [languages[x["y"]] for x in models]
    n = len(languages)
    logs = np.array([np.frombuffer(x["logs"]) for x in models]).reshape(n, BUCKETS * len(GRAMS))
    floor = -math.log(BUCKETS)
    seen = rows.mapInArrow(_likelihoods(logs), "doc_id long, declared string, host string, suffix string, mean array<double>, grams long")
    if not n:  # nothing but the declarations to go by
        known = F.col("declared").isNotNull() & (F.col("grams") > 0)
        nowhere = F.create_map().cast("map<string,double>")
        return seen.select(
            "doc_id", F.when(known, F.col("declared")).otherwise(UNKNOWN).alias("language"), F.when(known, 1.0).otherwise(0.0).alias("confidence"), (~known).alias("rejected"),
            F.when(known, F.create_map("declared", F.lit(1.0))).otherwise(nowhere).alias("posterior"),
        )

    best = F.array_position("mean", F.array_max("mean")).cast("int") - 1
    seen = stored(seen.withColumn("best", F.when(F.col("grams") > 0, best)), "language-likelihoods")

    world = np.ones(n)
    for x in seen.where("best is not null").groupBy("best").count().collect():
        world[x["best"]] += x["count"]
    top = F.array(*(F.lit(float(x)) for x in world / world.sum()))
    each = F.sequence(F.lit(0), F.lit(n - 1))
    smooth = lambda c, parent, m: F.when(F.col(c).isNull(), parent).otherwise(
        F.zip_with(c, parent, lambda x, p: (x + m * p) / (F.aggregate(c, F.lit(0).cast("long"), lambda a, y: a + y) + m))
    )
    trust = F.array(*(F.when(F.col("declared") == x, AGREE).otherwise(0.0) for x in languages))
    rates = _tally(seen, "declared", n).withColumn("trust", trust)
    of = F.array(*(F.lit(float(x)) for x in world + AGREE))
    rates = rates.select("declared", F.transform(each, lambda i: F.log((F.get("declared_n", i) + F.get("trust", i) + 0.5) / F.get(of, i))).alias("said"))
    out = seen.join(small(rates, 200 + 8 * n), "declared", "left")
    out = out.join(small(_tally(seen, "suffix", n), 64 + 8 * n), "suffix", "left").withColumn("of_suffix", smooth("suffix_n", top, PRIOR))
    out = out.join(small(_tally(seen, "host", n), 100 + 8 * n), "host", "left").withColumn("prior", smooth("host_n", F.col("of_suffix"), PRIOR))
    weight = F.least(F.col("grams").cast("double"), F.lit(INDEPENDENT))
    score = F.transform(each, lambda i: F.get("mean", i) * weight + F.log(F.get("prior", i)) + F.coalesce(F.get("said", i), F.lit(0.0)))
    out = out.withColumn("score", score).withColumn("most", F.array_max("score"))
    out = out.withColumn("p", F.transform("score", lambda x: F.exp(x - F.col("most"))))
    out = out.withColumn("all", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("p", lambda x: x / F.col("all")))
    names = F.array(*map(F.lit, languages))
    confidence = F.when(F.col("grams") > 0, F.array_max("p")).otherwise(0.0)
    language = F.when(F.col("grams") > 0, F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1)).otherwise(UNKNOWN)
    strange = F.array_max("mean") < floor
    alone = (F.col("grams") > 0) & F.col("declared").isNotNull() & ~F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))
    return out.select(
        "doc_id", F.when(alone, F.col("declared")).otherwise(language).alias("language"), F.when(alone, 1.0).otherwise(confidence).alias("confidence"), (~alone & ((confidence < SURE) | strange)).alias("rejected"),
        F.when(alone, F.create_map("declared", F.lit(1.0))).otherwise(F.map_from_arrays(names, "p")).alias("posterior"),
    )


def host_of(url: Column) -> Column:
    """The lower-cased host of an address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"\.([A-Za-z][A-Za-z0-9-]*)\.?$", 1)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)


def visible_text(html: Column) -> Column:
    """The html without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
