"""Order MinHash fingerprints of whole texts, in DataFrame functions alone.

The k-mers of a text are numbered by occurrence, and each numbered k-mer has a random place given by a hash. The places
fall into BINS equal ranges; of each, the PICKED smallest are selected, put back into the order they have in the text and
hashed as a tuple. Two texts agree in a bin only if they select the same k-mers in the same order there, so the share of
agreeing bins falls with edit distance, unlike that of plain minimal hashes, which ignore order and repetition.

k-mers are three words, or six code points for texts too short to have many words: texts of less than SHORT code points have
the latter, texts of LONG or more the former, and those between both, so that texts of like lengths can be compared.

A document's edited text needs the next document's beginning. Documents are dealt by id into ranges between approximate
quantiles (at most MOST, and proportional to the table below that); in each range ``lead`` gives the next text, and the
first document of the next range stands as a copy behind the last. So the texts are shuffled once, fingerprints are made
where they arrive, and ``lead`` over the same partitions gives the next document's fingerprint.

Defined results: null texts are empty; null ids come first, and rows of one id follow each other by a hash of their text;
ids that hold more than a range's share of the rows are spread over ranges of that hash; a single document is followed by
itself; a text without k-mers has empty parts; equal fingerprints have likeness 1, texts whose lengths have no kind of
k-mer in common 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.shared import stored

#: Ranges of the hash, and numbered k-mers selected in each.
BIN_BITS, PICKED = 6, 2
#: Texts of fewer code points than SHORT have six-character k-mers, of LONG or more three-word ones.
LONG, SHORT = 256, 1024
#: Documents of a range, and ranges at most.
RANGE, MOST = 500, 1 << 15
SPACE = r"[\x20\x09-\x0D]+"


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _grams(units: Column, scale: str) -> Column:
    """Hashes of the k-mers of an array; one shorter than k is one k-mer."""
    if scale == "words":
        hashed = F.transform(units, lambda x, i: F.xxhash64(x, F.get(units, i + 1), F.get(units, i + 2)))
        return F.slice(hashed, 1, F.greatest(F.size(units) - 2, F.lit(1)))
    return F.transform(units, lambda x, i: F.xxhash64(x, F.get(units, i + 1)))


def _tripled(pairs: Column) -> Column:
    """Hashes of six code points from those of two."""
    hashed = F.transform(pairs, lambda x, i: F.xxhash64(x, F.get(pairs, i + 2), F.get(pairs, i + 4)))
    return F.slice(hashed, 1, F.greatest(F.size(pairs) - 5, F.lit(1)))


def _new(rows: Column, j: Column) -> Column:
    """Whether row ``j`` of sorted (h, i) begins a run of equal hashes."""
    return (j == 0) | (F.get(rows, j - 1)["h"] != F.get(rows, j)["h"])


def _numbered(rows: Column, starts: Column) -> Column:
    """(g, i) of rows (h, i) that repeat an earlier k-mer, ``starts`` being where the runs of one k-mer begin."""
    run = lambda b, k: F.slice(rows, b + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - b)
    return F.flatten(F.transform(starts, lambda b, k: F.transform(run(b, k), lambda x, o: F.struct(F.xxhash64(x["h"], o + 1).alias("g"), x["i"].alias("i")))))


def with_codes(df: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` and, for each text column of ``texts``, its codes ``<name>_chars`` and ``<name>_words``.

    A code is an int, bin << 16 | 16 bits of the tuple's hash, for each bin that has a k-mer; null where a text has no such k-mers.
    """
    names = [(text, f"{name}_{scale}", scale) for text, name in texts.items() for scale in ("chars", "words")]
    units = []
    for text, name, scale in names:
        if scale == "chars":
            units.append(F.when(F.length(text) < SHORT, F.array_remove(F.split(text, ""), "")).alias(name))
        else:
            units.append(F.when(F.length(text) >= LONG, F.array_remove(F.split(text, SPACE), "")).alias(name))
    columns = [name for _, name, _ in names]
    df = df.select(*keep, *units)
    df = df.select(*keep, *(_grams(F.col(c), scale).alias(c) for _, c, scale in names))
    df = df.select(*keep, *((_tripled(F.col(c)) if scale == "chars" else F.col(c)).alias(c) for _, c, scale in names))
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    runs = lambda c: F.sort_array(F.transform(c, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, *columns, *(F.when(repeated(c), runs(F.col(c))).alias(f"{c}_s") for c in columns))
    later = lambda s: F.filter(s, lambda x, j: ~_new(s, j))
    df = df.select("*", *(later(F.col(f"{c}_s")).alias(f"{c}_l") for c in columns))
    starts = lambda s: F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)), lambda j: _new(s, j))
    df = df.select("*", *(starts(F.col(f"{c}_l")).alias(f"{c}_b") for c in columns))

    def places(c: str) -> Column:
        """(g, i) of all numbered k-mers; the place of a first occurrence is its k-mer's hash."""
        first = F.transform(F.filter(f"{c}_s", lambda x, j: _new(F.col(f"{c}_s"), j)), lambda x: F.struct(x["h"].alias("g"), x["i"].alias("i")))
        plain = F.transform(c, lambda h, i: F.struct(h.alias("g"), i.alias("i")))
        return F.sort_array(F.when(F.col(f"{c}_s").isNull(), plain).otherwise(F.concat(first, _numbered(F.col(f"{c}_l"), F.col(f"{c}_b")))))

    df = df.select(*keep, *columns, *(places(c).alias(f"{c}_p") for c in columns))
    other = lambda p, x, j: F.coalesce(_bin(F.get(p, j)["g"]) != _bin(x["g"]), F.lit(True))  # noqa: E731  nothing stands there, or another bin
    least = lambda p: F.filter(p, lambda x, j: other(p, x, j - PICKED))
    df = df.select(*keep, *columns, *(least(F.col(f"{c}_p")).alias(f"{c}_p") for c in columns))

    def codes(h: Column, p: Column) -> Column:
        def code(x: Column, j: Column) -> Column:
            y = F.get(p, j + 1)
            pair = F.xxhash64(F.get(h, F.least(x["i"], y["i"])), F.get(h, F.greatest(x["i"], y["i"])))
            both = F.when(other(p, x, j + 1), F.xxhash64(F.get(h, x["i"]))).otherwise(pair)
            return F.when(other(p, x, j - 1), (_bin(x["g"]) * 65536 + both.bitwiseAND(65535)).cast("int"))

        return F.filter(F.transform(p, code), lambda x: x.isNotNull())

    return df.select(*keep, *(codes(F.col(c), F.col(f"{c}_p")).alias(c) for c in columns))


def fingerprint(name: str) -> Column:
    """The codes as text: six hexadecimal digits for each bin, those of code points before the colon, of words behind it."""
    part = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), ""), F.lit(""))
    return F.concat(part(f"{name}_chars"), F.lit(":"), part(f"{name}_words"))


def likeness(a: str, b: str) -> Column:
    """Share of the bins filled in either text in which both have the same code: by code points if both have these, else by words."""

    def share(x: str, y: str) -> Column:
        bins = F.size(F.array_union(F.transform(x, lambda c: F.shiftright(c, 16)), F.transform(y, lambda c: F.shiftright(c, 16))))
        return F.when(bins > 0, F.size(F.array_intersect(x, y)) / bins).otherwise(0.0)

    both = [F.col(f"{a}_{s}").isNotNull() & F.col(f"{b}_{s}").isNotNull() for s in ("chars", "words")]
    same = fingerprint(a) == fingerprint(b)
    return F.when(same, 1.0).when(both[0], share(f"{a}_chars", f"{b}_chars")).when(both[1], share(f"{a}_words", f"{b}_words")).otherwise(0.0)


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return with_codes(df, {"text": "own"}, ["doc_id", "n_chars"]).select("doc_id", "n_chars", fingerprint("own").alias("fingerprint"))


def _ranges(docs: DataFrame, size: int) -> list[int]:
    """Approximate quantiles of the ids, one for each ``size`` rows, at most MOST; an id of many rows stands there more than once."""
    n = docs.count()
    parts = min(MOST, n // size)
    if parts < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10000, 10 * parts)).alias("x")).first()["x"]
    return sorted(found or [])


def with_next(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """Rows (bucket, part, doc_id, h, copy, text) in ranges of the order by id; the last of each range is a copy of the next one's first row."""
    cuts = _ranges(docs, size)
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = sorted(set(cuts))
    listed = F.array(*map(F.lit, cuts)).cast("array<long>")
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    below = lambda at, w: F.when(F.coalesce(F.get(listed, at + w - 1) <= F.col("doc_id"), F.lit(False)), at + w).otherwise(at)
    bucket = F.aggregate(widths, F.lit(0), below) if cuts else F.lit(0)  # the number of cuts that are not above the id, bit by bit
    crowded = F.col("doc_id").isNull() | F.col("doc_id").isin(hot) if hot else F.col("doc_id").isNull()
    rows = rows.withColumns({"bucket": F.when(F.col("doc_id").isNull(), -1).otherwise(bucket), "part": F.when(crowded, F.shiftright("h", 54)).otherwise(0).cast("int")})
    if hot:  # ids beside a crowded one in its range come before or after all its parts
        side = F.lit(0)
        for x in hot:
            side = F.when(F.col("bucket") == cuts.index(x) + 1, F.when(F.col("doc_id") > x, 1000).otherwise(F.col("part"))).otherwise(side)
        rows = rows.withColumn("part", F.when(crowded, F.col("part")).otherwise(side.cast("int")))
    place = F.struct("bucket", "part")
    first = rows.groupBy("bucket", "part").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    order = Window.orderBy("bucket", "part")  # over at most MOST ranges and the parts of ids that fill ranges
    before = F.coalesce(F.lag(place).over(order), F.max(place).over(Window.partitionBy()))
    first = stored(first.select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash"), before.alias("to")), "range-starts")
    copies = rows.join(F.broadcast(first), rows["doc_id"].eqNullSafe(first["id"]) & (rows["h"] == first["hash"]))
    copies = copies.dropDuplicates(["doc_id", "h", "to"]).select(F.col("to.bucket").alias("bucket"), F.col("to.part").alias("part"), "doc_id", "h", F.lit(True).alias("copy"), "text")
    return rows.select("bucket", "part", "doc_id", "h", F.lit(False).alias("copy"), "text").unionByName(copies)


def edited_fingerprints(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the beginning of the next document's text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): likenesses of a text to its
    edited text and to the next document's.
    """
    order = Window.partitionBy("bucket", "part").orderBy("copy", F.col("doc_id").asc_nulls_first(), "h")
    rows = with_next(docs, size).withColumns({"next": F.lead("text").over(order), "n_chars": F.length("text").cast("long")})
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next", F.lit(1), quarter))
    place = ["bucket", "part", "doc_id", "h", "copy", "n_chars"]
    rows = rows.select(*place, "text", edited.alias("edited"))
    rows = rows.select(*place, "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_codes(rows, {"text": "own", "edited": "edited"}, [*place, "edited_sha256"])
    rows = rows.withColumns({f"next_{s}": F.lead(f"own_{s}").over(order) for s in ("chars", "words")}).where(~F.col("copy"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
