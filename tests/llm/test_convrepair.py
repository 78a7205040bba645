import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from wayfold.llm.convrepair import Automaton, Repair, ROLE_GRAMMAR, repair_conversations

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def scripts(rows):
    """Edit scripts of rows (role, text, fault) that cost no more than to delete all rows: (cost, audit, roles and texts).

    Of those with the same roles so far, only the best is followed.
    """
    most = 2 * len(rows)

    def best(found):
        out = {}
        for cost, audit, made in found:
            key = tuple(r[:1] for r, _ in made)
            if cost <= most and (key not in out or (cost, audit) < out[key][:2]):
                out[key] = (cost, audit, made)
        return [*out.values()]

    def added(states):
        for _ in range(2):
            states = best([*states, *((c + 5, a + "I", [*out, (role, "")]) for c, a, out in states for role in ("user", "assistant"))])
        return states

    states = added([(0, "", [])])
    for role, text, fault in rows:
        after = []
        for cost, audit, out in states:
            after.append((cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                after.append((cost + extra, audit + "K", [*out, (role, text)]))
                after += [(cost + extra + 1, audit + "R", [*out, (new, text)]) for new in ("user", "assistant")]
        states = added(best(after))
    return states


def plain(turns):
    """turns: (turn, role, text) after damage, in order."""
    rows, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append((role, text, fault))
    fine = [x for x in scripts(rows) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in x[2]))]
    cost, audit, out = min(fine, key=lambda x: (x[0], x[1]))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest)


def damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def in_order(turns):
    return sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def conversations(seed, n, most):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", None, "", "tool", "User", "s"]
    texts = ["Yes.", "No!", "Why?", "well", "so on ", "a. \n", None, "", " \n"]
    return [
        (None if c == 3 else c, rng.choice([k, k, k, k, k + 1, None]), rng.choice(roles), rng.choice(texts))
        for c in range(n) for k in range(rng.randint(1, most))
    ]


def by_conversation(rows, change):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).extend(change(conv, turn, role, text))
    return {conv: in_order(turns) for conv, turns in out.items()}


def test_repair_is_the_cheapest_of_all_scripts(spark):
    rows = conversations(5, 120, 4)
    table = spark.createDataFrame(rows, ROWS).withColumns({"audit": F.lit("x"), "_fault": F.lit("y")}).repartition(5)
    for damaged, change in ((True, damage), (False, lambda c, t, r, x: [(t, " " if r is None else r, " " if x is None else x)])):
        found = {r[0]: tuple(r[1:]) for r in repair_conversations(table, damage=damaged).collect()}
        expected = {conv: plain(turns) for conv, turns in by_conversation(rows, change).items()}
        assert found == expected


def test_settled_audits_keep_their_order(monkeypatch):
    rng, automaton = random.Random(9), Automaton(ROLE_GRAMMAR)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(30)]
        results = []
        for most in (1, 5, 1000):
            monkeypatch.setattr("wayfold.llm.convrepair.TAIL", most)
            repair = Repair(automaton)
            for k, (role, must_go, truncated) in enumerate(rows):
                repair.add(role, str(k), must_go=must_go, truncated=truncated)
            results.append(repair.result())
        assert results[0] == results[1] == results[2]


def test_dropped_conversation_and_no_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repair_conversations(spark.createDataFrame([(conv, 0, "user", "Hi.")], ROWS), damage=True).collect()
    assert [tuple(r) for r in found] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_conversations(spark.createDataFrame([], ROWS)).collect() == []


def test_long_conversation_keeps_little():
    repair, rng = Repair(Automaton(ROLE_GRAMMAR)), random.Random(2)
    for k in range(20_000):
        repair.add(rng.choice(["user", "assistant"]), f"{k}.", must_go=k % 17 == 0, truncated=k % 13 == 0)
    assert max(len(x[2]) for x in repair.tops.values()) < 100
    assert len(repair.tops) <= 8 and len(repair.automaton.nodes) < 20
    cost, audit, _ = repair.result()
    assert len(audit) - audit.count("I") == 20_000
    assert audit.count("R") + 2 * audit.count("D") + 5 * audit.count("I") <= cost


def test_other_grammar():
    """Turns that go user, assistant, tool: the automaton comes from the rules."""
    automaton = Automaton({"Talk": [("Turn",), ("Talk", "Turn")], "Turn": [("u", "a", "t"), ("u", "a")]})
    repair = Repair(automaton)
    for role in ("user", "assistant", "tool", "user", "tool"):
        repair.add(role, "x.", must_go=False, truncated=False)
    assert repair.result()[:2] == (1, "KKKKR")
