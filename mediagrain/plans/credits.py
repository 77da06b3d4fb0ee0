"""Registered queries of credits.py, with their SQL.

The texts differ by supplier: labelled and unlabelled credits, French forms, brackets, lists, words that are no
names, unknown labels, long and short parts. The SQL parses the same texts from its own table of roles.
"""

from pyspark.sql import functions as F

from mediagrain.operators import credits as P
from mediagrain.sources.catalog import load

C = F.col
Q, SQL = {}, {}

#: A text for each supplier by its key; {n} is its name in letters, {m} another one.
TEMPLATES = (
    "Producer: {n}, Bob Dylan & X; Mixed by: {m}",
    "prod. par {n}\nécrit par {m} (live) | Guitar: {n}, various",
    "[intro] by {n}",
    "  par Bass guitar {n} and Ann-Marie;Executive producer: All rights; ok",
    "feat. {n} & {m}; Recording wizard : {n} et Jean D'Arc",
    "Vocals (lead): {n};backing vocals: {m};Photo: 99;: {n}",
    "Lyrics {n};mixé par {m}, {n};Co-producer: {m};Saxophone solo: {n}",
    "Arranger: {n} and {m} and {n} of the old town and {m} of the new town and everybody else who was in the room with us on that day",
    "Composer: {n}; composers: {n}y; Composer : {m}; Composer: {n}, {m}",
)


def texts(k):
    plain = lambda first, shift: F.concat(F.lit(first), F.translate(((C("s_suppkey") + shift) % 997).cast("string"), "0123456789", "abcdefghij"))
    n, m = plain("Supplier ", 0), plain("Anna ", 5)
    filled = F.array(*(F.replace(F.replace(F.lit(t), F.lit("{n}"), n), F.lit("{m}"), m) for t in TEMPLATES))
    return k.supplier.select(C("s_suppkey").alias("id"), F.get(filled, (C("s_suppkey") % len(TEMPLATES)).cast("int")).alias("text"))


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def ladder(x: str, role: bool) -> str:
    out = "CASE"
    for category, words, roles in P.LADDER:
        own = q(category) if not role else "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(r)}" for w, r in roles[:-1]) + f" ELSE {q(roles[-1][1])} END" if len(roles) > 1 else q(roles[-1][1])
        out += f" WHEN {' OR '.join(f'contains({x}, {q(w)})' for w in words)} THEN {own}"
    return out + (" END" if role else " ELSE 'other' END")


# DuckDB's \\b and \\w know ASCII only
SPELLED = [q(p.replace(r"\b(", r"(?:^|[^\pL\pN_])(").replace(r")\b", r")(?:[^\pL\pN_]|$)").replace(r"\w", r"[\pL\pN_]")) for p in P.ROLE_WORDS]
WORD = " ".join(f"WHEN regexp_extract(lower(raw), {p}, 1) <> '' AND contains(raw, regexp_extract(lower(raw), {p}, 1)) THEN regexp_extract(lower(raw), {p}, 1)" for p in SPELLED)
PARSED = rf"""WITH m AS (SELECT unnest([{', '.join(q(x) for x in P.ROLES)}]) AS label, unnest([{', '.join(q(x) for x in P.ROLES.values())}]) AS role, unnest(range({len(P.ROLES)})) AS rank),
s AS (SELECT s_suppkey AS id, ([{', '.join(q(t) for t in TEMPLATES)}])[s_suppkey % {len(TEMPLATES)} + 1] AS t, 'Supplier ' || translate(CAST(s_suppkey % 997 AS VARCHAR), '0123456789', 'abcdefghij') AS n, 'Anna ' || translate(CAST((s_suppkey + 5) % 997 AS VARCHAR), '0123456789', 'abcdefghij') AS m FROM supplier),
t AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(replace(t, '{{n}}', n), '{{m}}', m), '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '(?i)^(by|par)\s+', '') AS text FROM s),
r AS (SELECT id, unnest(ps) AS raw, unnest(range(len(ps))) AS pos FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '[;|\n]'), lambda p: regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '^[ .,;:]+|[ .,;:]+$', '', 'g')), lambda p: length(p) > 2) AS ps FROM t)),
f AS (SELECT *, CASE {WORD} END AS word, regexp_extract(raw, '(?i)(?:^|[^\pL\pN_]){P.FRENCH_ROLES}\s+([^,\n]+)', 1) AS fr FROM r),
l AS (SELECT id, pos, raw, CASE WHEN contains(raw, ':') THEN coalesce(nullif(trim(split_part(raw, ':', 1)), ''), 'Unknown') WHEN word IS NOT NULL THEN word WHEN fr <> '' THEN fr ELSE 'Unknown' END AS label,
  trim(CASE WHEN contains(raw, ':') THEN raw[position(':' IN raw) + 1:] WHEN word IS NOT NULL THEN raw[position(word IN raw) + length(word):] WHEN fr <> '' THEN regexp_extract(raw, '(?i)(?:^|[^\pL\pN_]){P.FRENCH_ROLES}\s+([^,\n]+)', 2) ELSE raw END) AS listed FROM f),
n AS (SELECT id, pos, raw, label, list_filter(list_transform(regexp_split_to_array(listed, '(?i)\s*[,&]\s*|\s+and\s+|\s+et\s+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 50 AND regexp_matches(x, '^\pL[\pL\s\-''.]{{1,50}}$') AND lower(x) NOT IN ({', '.join(q(x) for x in P.NO_NAMES)})) AS names FROM l),
x AS (SELECT *, lower(trim(label)) AS low FROM n WHERE len(names) > 0),
e AS (SELECT x.*, (SELECT any_value(m.role) FROM m WHERE m.label = low) AS exact, (SELECT arg_min(m.role, m.rank) FROM m WHERE contains(low, m.label) OR contains(m.label, low)) AS partly FROM x),
y AS (SELECT *, coalesce(exact, partly, {ladder('low', True)}, array_to_string(list_transform(string_split(low, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS role,
  round(greatest(0, least(1, 0.5 + CASE WHEN exact IS NOT NULL THEN 0.2 ELSE 0 END + 0.2 + CASE WHEN contains(raw, ':') THEN 0.1 ELSE 0 END - CASE WHEN length(raw) < 5 THEN 0.2 WHEN length(raw) > 100 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS confidence FROM e),
p AS (SELECT id, CAST(pos AS INT) AS pos, raw, label, names, role, {ladder('lower(role)', False)} AS category, confidence FROM y)
"""  # noqa: E501


def add(name, build, body=None):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    if body:
        SQL[name] = PARSED + body


parsed = lambda k: P.parse(texts(k), "id", "text")
names = lambda: F.array_join("names", ";").alias("names")
listed = "array_to_string(names, ';') AS names"
add("c01_parse_credits", lambda k: parsed(k).select("id", "pos", "raw", "label", names(), "role", "category", "confidence"), f"SELECT id, pos, raw, label, {listed}, role, category, confidence FROM p")
add("c02_clean_credit_text", lambda k: texts(k).select("id", P.clean_text(C("text")).alias("text")), "SELECT id, text FROM t")
add("c03_split_credits", lambda k: texts(k).select("id", F.posexplode(P.raw_credits(P.clean_text(C("text")))).alias("pos", "raw")), "SELECT id, CAST(pos AS INT) AS pos, raw FROM r")
add("c04_role_and_names", lambda k: texts(k).select("id", F.explode(P.raw_credits(P.clean_text(C("text")))).alias("raw")).select("id", "raw", P.role_and_names(C("raw")).alias("x")).select("id", "raw", C("x.role").alias("label"), C("x.names").alias("listed")), "SELECT id, raw, label, listed FROM l")
add("c05_valid_names", lambda k: parsed(k).select("id", "pos", F.explode("names").alias("name")), "SELECT id, CAST(pos AS INT) AS pos, unnest(names) AS name FROM x")
add("c06_credit_confidence", lambda k: parsed(k).groupBy("confidence").agg(F.count("*").alias("n"), F.min("raw").alias("example")), "SELECT confidence, count(*) AS n, min(raw) AS example FROM p GROUP BY 1")
add("c07_confident_credits", lambda k: parsed(k).filter("confidence >= 0.95").groupBy("role").agg(F.count("*").alias("n")), "SELECT role, count(*) AS n FROM p WHERE confidence >= 0.95 GROUP BY 1")
add("c08_role_categories", lambda k: parsed(k).groupBy("label", "role").agg(F.count("*").alias("n")), "SELECT label, role, count(*) AS n FROM p GROUP BY 1, 2")
add("c09_role_category", lambda k: parsed(k).groupBy("role", "category").agg(F.count("*").alias("n")), "SELECT role, category, count(*) AS n FROM p GROUP BY 1, 2")
add("c10_collaborations", lambda k: P.collaborations(parsed(k), "id").withColumn("featured", F.array_join("featured", ";")), "SELECT id, count(*) FILTER (WHERE len(names) > 1) AS shared, round(avg((len(names) > 1)::INT), 6) AS score, coalesce(sum(len(names)) FILTER (WHERE contains(lower(role), 'producer')), 0) > 1 AS multiple_producers, coalesce(array_to_string(list_sort(list_distinct(flatten(list(names) FILTER (WHERE contains(lower(role), 'feat'))))), ';'), '') AS featured FROM p GROUP BY 1")
add("c11_merge_credits", lambda k: P.merge_similar(parsed(k), "id").withColumn("names", F.array_join("names", ";")))  # a fold; tests/test_credits.py has a plain version
add("c12_by_category", lambda k: parsed(k).select("category", F.explode("names").alias("name")).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("name").alias("people")), "SELECT category, count(*) AS n, count(DISTINCT name) AS people FROM (SELECT category, unnest(names) AS name FROM p) GROUP BY 1")
add("a22_credit_insights", lambda k: parsed(k).select("role", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles")).orderBy(F.desc("n"), "name").limit(20), "SELECT name, count(*) AS n, count(DISTINCT role) AS roles FROM (SELECT role, unnest(names) AS name FROM p) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
