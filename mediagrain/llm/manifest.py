"""Merkle dataset manifest with checkpoint-and-recompute proofs.

Every row is a leaf; the leaves of a group (a source), in the order of their key, are the lowest level of a
tree in which every `FAN` consecutive nodes become their hash; the groups' roots are the leaves of one more
such tree. Hashes are lower-case hex SHA-256 of concatenated inputs. Steps:

1. Leaves are hashed in one pass over the rows and written. A range sort by (group, key, hash) spreads a hot
   group over all tasks; a row's place is its place in its task plus the rows of its group in earlier tasks.
2. Of the levels only every `STRIDE`-th is stored: the nodes of a level, cut into aligned subtrees of
   FAN ** STRIDE, give the next stored level. No task holds more of a group than one such subtree.
3. `proofs` goes from the top down. An aligned subtree meets the path of its stored root (one row each),
   regenerates its missing interior levels from its stored nodes, and emits the siblings of each of them;
   the regenerated nodes are never stored.

`folded` recomputes a root from a leaf and its path; `op11` does so for tampered rows.

Nulls and odd cases: a null field is `-`, an empty one `0:`; null groups form a group, the first one; null
keys come first; rows with equal keys stand in the order of their hashes, and equal rows in any order (they
have equal hashes); a lone leaf is its group's root and a lone group's root the root, without a sibling; an
empty table has no root and gives no rows; columns that aren't named are never looked at.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagrain.llm.components import new_folder, removed, sent, written

FAN, STRIDE = 16, 2
BLOCK = FAN**STRIDE
PATH = "array<struct<place:int,siblings:array<string>>>"


@dataclass
class Tree:
    """The stored levels of the trees of all groups, every STRIDE-th: tables of (grp, pos, n, hash), `n` the number of the group's leaves; the lowest also has the leaves' own columns."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(grp, hash): one node is left of each group."""
        return self.levels[-1].select("grp", "hash")


@dataclass
class Manifest:
    groups: Tree
    top: Tree


def canonical(*columns: str) -> Column:
    """The fields of a row: byte count and value of each, or `-`."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns))


def group_name(column: str) -> Column:
    """A name of the group that is never null; its bytewise order is that of the column, nulls first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def numbered(leaves: DataFrame, key: list[str]) -> DataFrame:
    """The leaves with `pos` (their place in the group by `key`, nulls first, from 0) and `n` (leaves of the group); written."""
    order = [F.col(c).asc_nulls_first() for c in ("grp", *key)]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33).alias("part")
    runs = ranged.groupBy("grp", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))  # a row for each task and group in it
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "runs")
    placed = ranged.withColumn("part", part).join(sent(runs), ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return written(placed.drop("at", "part", "shift"), "leaves")


def _hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(FAN)), lambda i: _hash(F.slice(nodes, i, FAN)))


def _several(level: int) -> Column:
    """Whether the group has more than one node at a level, so that they have parents."""
    return F.col("n") > FAN**level


def _subtrees(nodes: DataFrame, stored: int) -> DataFrame:
    """A row for each aligned subtree of a stored level: grp, block, n, `nodes` (the stored ones, by place) and level_0 to level_STRIDE, regenerated."""
    held = [c for c in nodes.columns if c not in ("grp", "n")]
    out = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *(c for c in held if c != "pos")))).alias("nodes"))
    out = out.withColumn("level_0", F.col("nodes.hash"))
    for k in range(STRIDE):
        out = out.withColumn(f"level_{k + 1}", F.when(_several(stored * STRIDE + k), _parents(F.col(f"level_{k}"))).otherwise(F.col(f"level_{k}")))
    return out


def grown(leaves: DataFrame) -> Tree:
    """The tree over numbered leaves: as many stored levels as the largest group needs."""
    levels, left = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while left > 1:
        subtrees = _subtrees(levels[-1].select("grp", "pos", "n", "hash"), len(levels) - 1)
        levels.append(written(subtrees.select("grp", F.col("block").alias("pos"), "n", F.col(f"level_{STRIDE}")[0].alias("hash")), "nodes"))
        left = -(-left // BLOCK)
    return Tree(levels)


def committed(leaves: DataFrame, key: list[str]) -> Manifest:
    """The manifest of leaves (grp, hash, the key columns and others, which are kept with the leaf)."""
    first = written(leaves, "hashed")
    groups = grown(numbered(first, [*key, "hash"]))
    removed_from(first)
    top = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    return Manifest(groups, grown(numbered(top, ["name"])))


def removed_from(table: DataFrame) -> None:
    """Deletes the folder of a written table that isn't needed any more."""
    files = table.inputFiles()
    if files:
        removed(table.sparkSession, files[0].rsplit("/", 1)[0])


def _paths(tree: Tree, above: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with `path`; `above`: grp, pos, path and `carried` of the trees' roots."""
    for stored in range(len(tree.levels) - 2, -1, -1):
        subtrees = _subtrees(tree.levels[stored], stored).join(above.select("grp", F.col("pos").alias("block"), "path", *carried), ["grp", "block"])

        def own(i: Column, stored: int = stored) -> Column:
            out = []
            for k in range(STRIDE):
                at = F.floor(i / FAN**k).cast("int")
                place = at % FAN
                run = F.slice(f"level_{k}", at - place + 1, FAN)
                others = F.concat(F.slice(run, F.lit(1), place), F.slice(run, place + 2, FAN))
                out.append(F.when(_several(stored * STRIDE + k), F.struct(place.alias("place"), others.alias("siblings"))))
            return F.filter(F.array(*out), lambda x: x.isNotNull()).cast(PATH)

        rows = subtrees.select("grp", "n", "path", *carried, F.explode(F.transform("nodes", lambda x, i: F.struct(x.alias("node"), own(i).alias("own")))).alias("x"))
        above = rows.select("grp", "n", "x.node.*", F.concat("x.own", "path").alias("path"), *carried)
    return above if len(tree.levels) > 1 else tree.levels[0].join(above.drop("pos"), "grp")


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves with `path` (for each level with siblings, bottom up: the node's place in its run and its siblings), `subroot` and `root`."""
    start = manifest.top.roots.select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    groups = _paths(manifest.top, start, ["root"])
    groups = groups.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root")
    return _paths(manifest.groups, groups, ["subroot", "root"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(node: Column, step: Column) -> Column:
        place, others = step["place"], step["siblings"]
        return _hash(F.concat(F.slice(others, F.lit(1), place), F.array(node), F.slice(others, place + 1, FAN)))

    return F.aggregate(path, leaf, up)


def siblings_digest(path: Column) -> Column:
    return _hash(F.flatten(F.transform(path, lambda step: step["siblings"])))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fields = ("doc_id", "source", "lang", "n_chars")
    damaged = F.when(chosen, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    leaf = lambda *c: F.sha2(canonical(*c), 256)
    leaves = docs.withColumn("damaged", damaged).select(group_name("source").alias("grp"), "doc_id", leaf(*fields, "text").alias("hash"), leaf(*fields, "damaged").alias("claimed"))
    found = proofs(committed(leaves, ["doc_id"]))
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(depth: int = 6) -> str:
    """The same in SQL, for groups of at most 16 ** depth leaves: all levels of both trees, then the siblings of every leaf level by level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [1,2,3,4,5,6,7,8]::BIGINT[]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
    first = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    steps = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({first} || {field('text')}) AS leaf, sha256({first} || {field(f'CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END')}) AS claimed FROM documents)",
        "s0 AS (SELECT grp, leaf AS h, doc_id, claimed, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d)",
    ]
    for tree in ("s", "t"):
        if tree == "t":
            steps.append(f"t0 AS (SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM s{depth})")
        for k in range(depth):
            up = f"CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END"
            steps.append(f"{tree}{k + 1} AS (SELECT grp, pos // 16 AS pos, {up} AS h, (n + 15) // 16 AS n FROM {tree}{k} GROUP BY grp, pos // 16, n)")
    places = {"s": "l.pos", "t": "t0.pos"}
    columns, joins = [], ["s0 AS l", "JOIN t0 ON t0.name = l.grp", f"JOIN t{depth} AS top ON true"]
    for tree in ("s", "t"):
        for k in range(depth):
            steps.append(f"{tree}r{k} AS (SELECT grp, pos // 16 AS run, list(h ORDER BY pos) AS hs, n FROM {tree}{k} GROUP BY grp, pos // 16, n)")
            at = f"({places[tree]} // {16**k})"
            joins.append(f"JOIN {tree}r{k} ON {tree}r{k}.grp = {'l.grp' if tree == 's' else chr(39) * 2} AND {tree}r{k}.run = {at} // 16")
            columns.append((f"{tree}r{k}", f"{at} % 16"))
    others = ", ".join(f"CASE WHEN {r}.n > 1 THEN array_to_string(list_concat({r}.hs[1:{at}], {r}.hs[{at} + 2:]), '') ELSE '' END" for r, at in columns)
    steps.append(f"f0 AS (SELECT l.doc_id, l.h AS leaf, t0.h AS subroot, top.h AS root, sha256(concat({others})) AS proof_sha256, l.claimed AS node, {', '.join(f'{r}.hs AS {r}, {r}.n AS n{r}, {at} AS at{r}' for r, at in columns)} FROM {' '.join(joins)})")
    for k, (r, _) in enumerate(columns):
        steps.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN n{r} > 1 THEN sha256(array_to_string({r}[1:at{r}], '') || node || array_to_string({r}[at{r} + 2:], '')) ELSE node END AS node) FROM f{k})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM f{len(columns)}"


SQL11 = _sql()
