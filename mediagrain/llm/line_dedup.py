"""Line de-duplication by content-defined line chunks, in DataFrame functions only.

Every line is hashed; a chunk ends where a rolling hash over two consecutive line hashes is a local minimum,
so boundaries move with the content, not with line numbers, and every chunk has two lines or more (three on
average; a text of one line has no chunk). A chunk whose bytes occurred before (a smaller doc_id, or further
up in the same text) is removed. Steps:

1. chunk hashes of the scan, without text, are written and counted; hashes that occur once go no further
   (the count is pre-aggregated in every task, so a hot chunk is a row for each task);
2. the bytes of chunks with a repeated hash are cut out of the texts and grouped by hash and bytes, again
   pre-aggregated: a hash alone removes nothing. The place of each group's first chunk goes back to the other
   chunks by two hashes and the length, unless two groups share these; hot hashes by broadcast (`spread`);
3. the texts, dealt out by doc_id once for steps 2 and 3, drop their removed chunks.

Nulls and odd cases: a null text stays null, an empty one empty; rows with a null doc_id pass unchanged
and are nobody's first; rows with the same doc_id and text count as one (all keep or lose the same
chunks); of equal chunks the one with the smallest doc_id, then the first in its text, stays; an empty table
gives no rows; other columns, whatever their names, pass unchanged; single lines are never removed, however
often they occur.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.components import written


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def chunk_bounds(lines: Column) -> Column:
    """An array of structs (s, e): first and last line of each chunk."""
    hashes = F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"))
    rolled = _let(hashes, lambda h: F.zip_with(h, F.concat(F.array(F.lit(0).cast("long")), h), lambda a, b: (a + 31 * b) % (1 << 32)))
    below = lambda r: F.zip_with(r, F.concat(F.array(F.lit(None).cast("long")), r), lambda a, b: a < b)
    above = lambda r: F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: a <= b)
    least = _let(rolled, lambda r: F.zip_with(below(r), above(r), lambda x, y: x & y))
    cut = F.filter(F.transform(least, lambda hit, i: F.when(hit & (i >= 1) & (i <= F.size(lines) - 3), i)), lambda i: i.isNotNull())
    return _let(cut, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), F.transform(c, lambda i: i + 1)), F.concat(c, F.array(F.size(lines) - 1)), lambda s, e: F.struct(s.alias("s"), e.alias("e"))))


def _chunk(lines: Column, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(lines, s + 1, e - s + 1), "\n")


def with_removed(docs: DataFrame, floor: int = 1000) -> DataFrame:
    """The rows of `docs` as struct `row`, with `lines`, `removed` (array of (s, e), or null) and `kept` (the new text).

    Hashes of more than `floor` chunks, and of more than one in 4096 of all repeated ones, are hot.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    rest = [(i, c) for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    dealt = texts.select("id", "lines", *(F.col("row")[c].alias(f"row_{i}") for i, c in rest))
    unnamed = dealt.filter("id is null").withColumn("removed", F.lit(None).cast("array<struct<s:int,e:int,h:bigint>>"))
    dealt = dealt.filter("id is not null").repartition("id")

    chunks = texts.filter("id is not null and size(lines) > 1").select("id", "lines", F.explode(chunk_bounds(F.col("lines"))).alias("c"))
    chunks = written(chunks.select("id", "c.s", "c.e", F.xxhash64(_chunk(F.col("lines"), F.col("c.s"), F.col("c.e"))).alias("h")), "chunks")
    often = written(chunks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    total, top = often.agg(F.sum("n"), F.max("n")).first()
    limit = max(floor, (total or 0) // 4096)  # so at most 4096 hashes are hot
    hot = (top or 0) > limit

    def spread(rows: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
        """The join of both on the keys, by broadcast for hot hashes; both know the hash's n."""
        if not hot:
            return rows.join(by.drop("n"), keys)
        return rows.filter(F.col("n") <= limit).join(by.filter(F.col("n") <= limit).drop("n"), keys).unionByName(rows.filter(F.col("n") > limit).join(F.broadcast(by.filter(F.col("n") > limit).drop("n")), keys))

    if hot:
        most = F.broadcast(often.filter(F.col("n") > limit))
        repeated = chunks.join(most, "h").unionByName(chunks.join(most.select("h"), "h", "left_anti").join(often.filter(F.col("n") <= limit), "h"))
    else:
        repeated = chunks.join(often, "h")
    wanted = repeated.groupBy("id").agg(F.collect_set(F.struct("s", "e", "h", "n")).alias("wanted"))

    found = dealt.join(wanted, "id").select("id", "lines", F.explode("wanted").alias("c"))
    found = found.select("id", "c.s", "c.e", "c.h", "c.n", _chunk(F.col("lines"), F.col("c.s"), F.col("c.e")).alias("bytes")).filter(F.xxhash64("bytes") == F.col("h"))
    key = ["h", "h2", "size"]
    place = F.struct("id", "s")
    first = found.groupBy("h", "n", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    first = first.select("h", "n", F.xxhash64("bytes", F.lit(1)).alias("h2"), F.octet_length("bytes").alias("size"), "first", "times")
    first = first.groupBy(*key, "n").agg(F.min("first").alias("first"), F.sum("times").alias("times"), F.count("*").alias("kinds")).filter("times > 1 and kinds = 1").drop("times", "kinds")
    found = found.select("id", "s", "e", "n", "h", F.xxhash64("bytes", F.lit(1)).alias("h2"), F.octet_length("bytes").alias("size"))
    later = spread(found, first, key).filter(place > F.col("first"))
    removed = later.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("s", "e", "h"))).alias("removed"))

    own = F.filter("removed", lambda c: F.xxhash64(_chunk(F.col("lines"), c["s"], c["e"])) == c["h"])
    out = dealt.join(removed, "id", "left").withColumn("removed", own).unionByName(unnamed)
    after = F.concat(F.array(F.lit(0)), F.transform("removed", lambda c: c["e"] + 1))
    before = F.concat(F.transform("removed", lambda c: c["s"] - 1), F.array(F.size("lines") - 1))
    pieces = F.filter(F.zip_with(after, before, lambda a, b: F.struct(a.alias("s"), b.alias("e"))), lambda c: c["e"] >= c["s"])
    kept = F.array_join(F.transform(pieces, lambda c: _chunk(F.col("lines"), c["s"], c["e"])), "\n")
    kept = F.when(F.coalesce(F.size("removed"), F.lit(0)) <= 0, F.array_join("lines", "\n")).otherwise(kept)
    row = F.struct(*((F.array_join("lines", "\n") if c == "text" else F.col("id" if c == "doc_id" else f"row_{i}")).alias(c) for i, c in enumerate(docs.columns)))
    return out.select(row.alias("row"), "lines", "removed", kept.alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, columns unchanged, without their repeated chunks; those of which nothing is left go."""
    out = with_removed(docs)
    cut = F.coalesce(F.size("removed"), F.lit(0)) > 0
    cols = {c: F.col("row")[c].alias(c) for c in docs.columns} | {"text": F.col("kept").alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.filter(~cut | (F.trim(F.translate("kept", "\n\t\r", "   ")) != "")).select(*[cols[c] for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<s:int,e:int,h:bigint>>")), F.lit(0).cast("long"), lambda a, c: a + c["e"] - c["s"] + 1)
    return with_removed(docs).select("row.doc_id", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), gone.alias("n_removed_lines"), F.sha2("kept", 256).alias("kept_sha256"))


SQL10 = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, lines, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM l),
w AS (SELECT doc_id, lines, list_transform(range(1, len(lines) + 1), lambda i: (h[i] + 31 * coalesce(h[i - 1], 0)) % 4294967296) AS r FROM v),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i, r FROM w),
b AS (SELECT doc_id, i, lines[i] AS line, CASE WHEN i - 1 BETWEEN 2 AND len(lines) - 2 AND r[i - 1] < r[i - 2] AND r[i - 1] <= r[i] THEN 1 ELSE 0 END AS fresh FROM p),
c AS (SELECT doc_id, i, line, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
g AS (SELECT doc_id, k, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS txt FROM c GROUP BY doc_id, k),
r AS (SELECT doc_id, k, s, n, txt, n > 1 AND row_number() OVER (PARTITION BY txt, n > 1 ORDER BY doc_id, s) > 1 AS gone FROM g),
o AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(string_agg(txt, chr(10) ORDER BY s) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)
"""
