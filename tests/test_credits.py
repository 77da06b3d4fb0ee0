"""Credit parsing on single texts, and the merging of like credits against a plain version."""

from mediagrain.operators import credits as P
from mediagrain.plans import credits as plan
from mediagrain.sources.catalog import load

SF = "/root/testdata/sf0.001"


def parsed(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r.label, r.names, r.role, r.category, r.confidence) for r in P.parse(df, "id", "text").orderBy("pos").collect()]


def test_forms(spark):
    assert parsed(spark, "Producer: Ann, Bob & Zed (live)") == [("Producer", ["Ann", "Bob", "Zed"], "Producer", "production", 1.0)]
    assert parsed(spark, "by Ann\nmixé par Zoë\nécrit par Léa") == [("Unknown", ["Ann"], "Unknown", "other", 0.5), ("mixé", ["par Zoë"], "Mixing Engineer", "engineering", 0.7), ("écrit par", ["Léa"], "Songwriter", "songwriting", 0.9)]
    assert parsed(spark, "guitar Ann; various; Xy") == [("guitar", ["Ann"], "Guitarist", "musician", 0.9)]
    assert parsed(spark, "Bass: 42") == [] and parsed(spark, "") == [] and parsed(spark, None) == []
    assert parsed(spark, "Photographer: Ann")[0][2] == "Rapper"  # the first label in order that the text holds


def near(a, b):
    a, b = a.lower(), b.lower()
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


def merged(credits):
    groups = []
    for c in credits:
        for g in groups:
            if (g["role"].lower() == c.role.lower() or near(g["role"], c.role) >= 0.8) and any(a.lower() == b.lower() or near(a, b) > 0.85 for a in g["first"] for b in c.names):
                g["names"] |= set(c.names)
                g["confidence"], g["merged"] = max(g["confidence"], c.confidence), g["merged"] + 1
                break
        else:
            groups.append({"role": c.role, "first": c.names, "names": set(c.names), "confidence": c.confidence, "merged": 1})
    return [(i, g["role"], sorted(g["names"]), g["confidence"], g["merged"]) for i, g in enumerate(groups)]


def test_like_credits_merge(spark):
    credits = P.parse(plan.texts(load(spark, SF)), "id", "text").cache()
    want = {}
    for r in credits.orderBy("id", "pos").collect():
        want.setdefault(r.id, []).append(r)
    got = {}
    for r in P.merge_similar(credits, "id").orderBy("id", "grp").collect():
        got.setdefault(r.id, []).append((r.grp, r.role, r.names, r.confidence, r.merged))
    assert got == {k: merged(v) for k, v in want.items()} and any(x[4] > 1 for v in got.values() for x in v)
