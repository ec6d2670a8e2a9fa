"""Conversation repair against a plain dynamic programme over every edit."""

import hashlib
import random

import pytest
from helpers import LONG, empty

from pulsemark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, audit string, block string"
DUE = {0: 2, 1: 2, 2: 3, 3: 2}


def plain(rows):
    """Least (cost, audit): all edits of all rows, states in order, insertions before every row and at the end."""
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    labels = {0: (0, "")}

    def offer(to, label, into):
        if to not in into or label < into[to]:
            into[to] = label

    for initial, must_go, cut in [*rows, (None, True, False)]:
        for _ in range(3):
            for state, (cost, audit) in list(labels.items()):
                offer(DUE[state], (cost + 5, audit + "I"), labels)
        if initial is None:
            break
        after = {}
        for state, (cost, audit) in labels.items():
            offer(state, (cost + 2, audit + "D"), after)
            if not must_go:
                if state in kept.get(initial, {}):
                    offer(kept[initial][state], (cost + 5 * cut, audit + "K"), after)
                offer(DUE[state], (cost + 1 + 5 * cut, audit + "R"), after)
        labels = after
    return min(labels[s] for s in (0, 3) if s in labels)


def random_rows(rng, most):
    return [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("block", [256, 3, 1])
def test_cost_and_audit_equal_the_plain_programme(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        rows = random_rows(rng, 11)
        assert conversations.repair_rows(rows) == plain(rows), rows


def test_repaired_roles_follow_the_pattern():
    rng = random.Random(4)
    for _ in range(500):
        rows = random_rows(rng, 9)
        _, audit = conversations.repair_rows(rows)
        said = [(initial, str(i)) for i, (initial, _, _) in enumerate(rows)]
        made = list(conversations.turns(audit, sum(e != "D" for e in audit) % 2 == 1, 0, said))
        initials = "".join(r[:1] for r, _ in made)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"
        assert [t for _, t in made if t] == [t for (_, t), e in zip(said, audit.replace("I", "")) if e != "D"]


def talk(spark):
    rng = random.Random(9)
    rows = [(1, t, r, x, "a", "b") for t, r, x in [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "user", "Hi."), (4, "assistant", "Hello"), (5, "assistant", "Hello there.")]]
    rows += [(2, None, "user", "First?", "a", "b"), (2, 0, "assistant", "Yes.", "a", "b"), (2, 0, None, None, "a", "b"), (2, 7, "user", "  \t", "a", "b")]
    rows += [(None, 3, "tool", "Odd one.", None, None), (None, None, "", LONG, None, None), (3, None, "assistant", "Alone!", None, None)]
    for k in range(40):
        for t in range(rng.randint(1, 30)):
            rows.append((10 + k, t, rng.choice(["system", "user", "assistant"]), rng.choice(["One.", "Two", "", "Three!"]) + str(rng.randint(0, 9)) * rng.randint(0, 1), None, None))
    return spark.createDataFrame(rows, SCHEMA)


def test_report_counts_and_hashes(spark):
    got = {r.conv_id: r for r in conversations.report(talk(spark)).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (1, 0, 1, 1, 2)
    assert (one.cost, one.audit) == (4, "KKDDK")
    assert one.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Hello there.").hexdigest()
    two = got[2]
    assert (two.gaps, two.blank, two.audit, two.cost) == (6, 2, "KDKD", 4)
    assert got[3].gaps == 0 and got[3].audit == "D" and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    none = got[None]
    assert (none.gaps, none.illegal, none.audit, none.cost) == (0, 1, "DD", 4)  # the long text is cut short
    assert conversations.report(empty(talk(spark))).count() == 0


def test_long_conversations_give_the_same_rows(spark, monkeypatch):
    rows = conversations.damaged(talk(spark))
    want = {r.conv_id: r for r in conversations.report(talk(spark), rows).collect()}
    monkeypatch.setattr(conversations, "LONG", 1)
    monkeypatch.setattr(conversations, "BLOCK", 4)
    spark.conf.set("spark.pulsemark.hotRows", "5")
    try:
        got = {r.conv_id: r for r in conversations.report(talk(spark), rows).collect()}
    finally:
        spark.conf.unset("spark.pulsemark.hotRows")
    assert got == want and len(got) == 44


def test_a_conversation_lost_whole_is_still_reported(spark):
    rows = spark.createDataFrame([(k, 0, "user", "Hi.") for k in range(200)], "conv_id long, turn long, role string, text string")
    kinds = conversations.damaged(rows).where("not present")
    assert kinds.count() > 0
    got = {r.conv_id: r for r in conversations.report(rows, conversations.damaged(rows)).collect()}
    assert len(got) == 200
    for r in kinds.collect():
        lost = got[int(r.conv_key[1:])]
        assert (lost.cost, lost.audit, lost.gaps, lost.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
