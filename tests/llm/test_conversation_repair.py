import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from mediagrain.llm import conversation_repair as c

WORD = re.compile("[^\x20\x09-\x0d]")


def plain_cheapest(rows):
    """rows: (initial, fault). (cost, audit), by trying everything from the back; a run of inserted turns has at most two."""

    def state_after(state, letter):
        """The states of the pattern (s?(ua)+)?: '', s, u, a."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

    @cache
    def best(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        choices = []
        if inserted < 2:
            choices += [("I", 5, state_after(state, x), i, inserted + 1) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            more = 5 * (fault == "truncated")
            choices.append(("D", 2, state, i + 1, 0))
            if fault not in ("blank", "duplicate"):
                choices.append(("K", more, state if initial == "" else state_after(state, initial), i + 1, 0))
                choices += [("R", 1 + more, state_after(state, x), i + 1, 0) for x in "ua"]
        for letter, cost, to, j, k in choices:
            if to is not None and (rest := best(j, to, k)):
                out.append((cost + rest[0], letter + rest[1]))
        return min(out) if out else None

    return best(0, "", 0)


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in found:
            said = WORD.findall(text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        cost, audit = plain_cheapest(list(zip(initials, faults, strict=True)))
        left, at, said = "", 0, []
        for letter in audit:
            role = "assistant" if left.endswith("u") else "user"
            if letter == "I":
                said.append(f"{role}:")
                left += role[0]
            else:
                _, own, text = found[at]
                at += 1
                if letter in "KR":
                    said.append(f"{own if letter == 'K' else role}:{text}")
                    left += own[:1] if letter == "K" else role[0]
        assert re.fullmatch("(s?(ua)+)?", left)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return order(map(tuple, c.op12(spark, str(tmp_path)).collect()))


def test_whole_table(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert order(map(tuple, c.op12(spark, sf).collect())) == order(brute(rows))


@pytest.mark.parametrize("seed", range(40))
def test_search_is_exact(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(rng.choice("suuuaaax") if rng.random() < 0.9 else "", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.choice([0, 1, 2, 5, 9, 20]))]
        codes = bytes(3 * (c.INITIALS.index(a) if a in c.INITIALS else 4) + {"": 0, "truncated": 2}.get(f, 1) for a, f in rows)
        want = plain_cheapest(rows)
        for chunk in (1, 2, 3, 7, 256):
            assert c.cheapest(codes, chunk) == want, (rows, chunk)
        assert c.bounds(codes, True)[0] <= want[0]


def test_spans_between_states():
    """No state's best end is dearer than another's by more than SPAN, whatever follows."""
    rng = random.Random(1)
    for _ in range(400):
        codes = bytes(rng.randrange(15) for _ in range(rng.randrange(9)))
        costs = [c.search(codes, [(state, 0, 0)], True)[0][1] for state in range(4)]
        assert max(costs) - min(costs) <= c.SPAN


def test_dominance_and_bounds_keep_the_search_small(monkeypatch):
    rng = random.Random(5)
    codes = bytes(rng.randrange(15) for _ in range(4000))
    taken = []
    monkeypatch.setattr(c, "MOVES", [[taken_from(m, taken) for m in row] for row in c.MOVES])
    c.cheapest(codes)
    assert len(taken) < 30 * len(codes)


class taken_from(list):
    def __init__(self, moves, log):
        super().__init__(moves)
        self.log = log

    def __iter__(self):
        self.log.append(1)
        return super().__iter__()


ODD = [
    (None, None, None, None),
    (None, 1, "user", "a null conversation."),
    (1, None, "user", "no turn?"),
    (1, 3, "assistant", "it breaks off"),
    (1, 3, "assistant", "two of a turn."),
    (1, 3, "assistant", "two of a turn."),
    (2, 9, "", "no role."),
    (2, 5, "System", "not s."),
    (2, 7, "tool", "x" * 70_000),
    (3, 1, "system", "alone."),
    (4, -5, "user", " "),
    (4, 2, "user", " \t\n"),
    (4, 2, "é", "q\x1c"),
]


@pytest.mark.parametrize("rows", [[], ODD, [(i // 9, i % 9, "suat"[i * 7 % 4], f"Turn {i * i % 5}" + "." * (i % 2)) for i in range(600)]])
def test_odd_rows_and_sql(spark, tmp_path, rows):
    got = run(spark, rows, tmp_path)
    assert got == order(brute(rows))
    d = duckdb.connect()
    d.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert order(d.execute(c.SQL12).fetchall()) == got


def test_a_long_conversation(spark, tmp_path):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), f"Turn {rng.randrange(900)}" + rng.choice([".", "?", ""])) for i in range(260)] + [(8, 0, "user", "Hi.")]
    assert run(spark, rows, tmp_path) == order(brute(rows))


def test_columns_that_clash_and_text_keys(spark):
    rows = [("a", 1, "user", "Hi.", 0, "x"), ("a", 2, "user", "Yes.", 1, "y"), (None, 1, "assistant", "Hm.", 2, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, part int, audit string")
    got = {r.conv_id: (r.cost, r.audit) for r in c.repairs(df).collect()}
    assert got == {"a": (1, "KR"), None: (2, "D")}
    edited = c.repaired(df, c.repairs(df)).collect()
    assert [(r.edit, r.role, r.text) for r in edited if r.conv_id == "a"] == [("K", "user", "Hi."), ("R", "assistant", "Yes.")]
