"""Conversation repair against every possible sequence of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfline.llm import conversation_repair as repair

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, id string, damaged int, there string"


def faults_of(rows):
    """Fault of each (role, text)."""
    out = []
    for i, (role, text) in enumerate(rows):
        bare = text.strip(repair.WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in rows[:i] else "truncated" if bare[-1] not in ".!?" else "")
    return out


def brute(rows, inserts=3):
    """(cost, audit, lines) of the cheapest edits, over all edits of each row and up to ``inserts`` insertions."""
    faults, best = faults_of(rows), None
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            own += [("K", extra, (role, text))] + [("R", 1 + extra, (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    slots = [list(itertools.chain.from_iterable(itertools.product(("user", "assistant"), repeat=k) for k in range(inserts + 1)))] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        for put in itertools.product(*slots):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            turns, audit = [], ""
            for i, added in enumerate(put):
                audit += "I" * len(added)
                turns += [(r, "") for r in added]
                if i < len(edits):
                    audit += edits[i][0]
                    turns += [edits[i][2]] if edits[i][2] else []
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                found = cost, audit, tuple(f"{r}:{t}" for r, t in turns)
                best = found if best is None else min(best, found)
    return best


def run_rows(rows, block):
    talk, seen = repair.Conversation(block), set()
    for i, (role, text) in enumerate(rows):
        talk.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return talk.finish()


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "cut", " ", f"{rng.random()}.", f"{rng.random()}"]))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_lightest_edits_against_all_edits(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(0, 3))
    cost, audit, lines = brute(rows, 2)
    for block in (1, 2, 64):
        got = run_rows(rows, block)
        assert got[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_blocks_do_not_change_the_answer():
    rng = random.Random(1)
    for n in (7, 65, 200):
        for rows in (some_rows(rng, n), [("tool", f"{i}.") for i in range(n)]):  # the second keeps two courses open to the end
            assert len({run_rows(rows, block) for block in (1, 3, 64, 1000)}) == 1


def test_agenda_joins_two_antecedents():
    facts = {"a": (1, "x"), "b": (5, "")}
    edges = [(("a", "b"), "c", 1, "k"), (("a",), "c", 9, "z"), (("c",), "goal", 0, "")]
    assert repair.lightest(facts, edges, ["goal"]) == {"goal": (7, "xk", "a")}
    assert repair.lightest({"a": (1, "x")}, edges[:1], ["c"]) == {}


def test_damage_lots(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(6)]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{c}:{t}".encode()) % 20
        mine = [r for r in got if (r["conv_id"], r["turn"]) == (c, t)]
        assert len(mine) == (2 if lot == 3 else 1)
        assert mine[0]["damaged"]["there"] == (lot != 0)
        assert mine[0]["role"] == ("user" if lot == 4 else role)
        assert mine[0]["text"] == {1: "", 2: "One Two"}.get(lot, text)


def test_awkward_rows(spark):
    long = "word " * 100_000 + "end."
    plain = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
             (2, None, "system", "Be kind."), (2, 3, "user", long), (2, 3, "user", long), (2, 7, None, None), (2, 9, "assistant", "Cut"),
             (None, None, None, None), (None, 2, "user", "Q?"), (None, 2, "assistant", "A."), (3, None, None, ""), (4, 5, "", "x."),
             (5, 1, "user", "b."), (5, 1, "user", "a."), (5, 1, "user", "a.")]
    frame = spark.createDataFrame([(*r, "i", 1, "t") for r in plain], SCHEMA)
    got = {r["conv_id"]: r for r in repair.repair_report(frame).collect()}
    made = {}
    for r in sorted(repair.repaired_turns(frame).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["place"])):
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, report in got.items():
        rows = sorted(((t is not None, t, r or " ", x or ("" if x == "" else " ")) for c, t, r, x in plain if c == conv), key=lambda r: (r[0], r[1] or 0, r[2:]))
        pairs = [r[2:] for r in rows]
        cost, audit, lines = brute(pairs, 1 if len(pairs) > 3 else 2)
        assert (report["cost"], report["audit"]) == (cost, audit)
        assert report["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [f"{r}:{t}" for r, t, _ in made.get(conv, [])] == list(lines)
        assert "".join(e for _, _, e in made.get(conv, [])) == audit.replace("D", "")
        known = [r[1] for r in rows if r[0]]
        assert report["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [report[n] for n in ("blank", "duplicate", "truncated")] == [faults_of(pairs).count(n) for n in ("blank", "duplicate", "truncated")]
        initials = [r[0][:1] for r in pairs]
        assert report["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(nothing).collect() == [] == repair.repaired_turns(nothing).collect()
    assert repair.repair_report(repair.damage(nothing), marks="damaged").collect() == []


def test_dropped_conversation_stays(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    row = repair.repair_report(repair.damage(frame), marks="damaged").collect()[0]
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
