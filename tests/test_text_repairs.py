"""Graders against plain tests, repairs by gap keys on small texts."""

import random
import time

import pytest

from lorekeep.operators import gaps, graders


def test_many_rules_in_one_pass(spark):
    rng = random.Random(2)
    texts = [(i, i % 3, "".join(rng.choice("ab \n") for _ in range(60))) for i in range(40)] + [(90, 0, None), (91, 1, ""), (92, 7, "no rules")]
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    rules = [(n, n % 3, graders.LITERAL[n % 4 % 3] if n % 4 < 3 else "ends with", w, 1) for n, w in enumerate(words)] + [(1000, 0, "width", None, 20), (1001, 1, "matches", r"a{3}", 0), (1002, 1, "matches not", r"a{3}", 0), (1003, 2, "section", "ab", 0), (1004, 2, "has", "", 0)]
    texts += [(93, 2, "x\n## ab \ny")]
    got = graders.graded(spark.createDataFrame(texts, "id long, case long, text string"), spark.createDataFrame(rules, "rule_id long, case long, kind string, value string, n int"))
    import re

    def plain(kind, value, n, t):
        last = next((x for x in reversed(t.split("\n")) if x.strip()), "")
        return {"has": lambda: value in t, "lacks": lambda: value not in t, "at most": lambda: t.count(value) <= n, "ends with": lambda: value in last, "width": lambda: max(map(len, t.split("\n"))) <= n,
                "matches": lambda: bool(re.search(value, t)), "matches not": lambda: not re.search(value, t), "section": lambda: bool(re.search(r"(?m)^#{1,6}[ \t]+" + value + r"[ \t]*$", t))}[kind]()

    want = sorted((i, r, plain(k, v or "", n, t or "")) for i, c, t in texts for r, rc, k, v, n in rules if rc == c)
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        graders.graded(spark.createDataFrame(texts[:1], "id long, case long, text string"), spark.createDataFrame([(1, 0, "none", "x", 0)], "rule_id long, case long, kind string, value string, n int"))


def test_time_hardly_grows_with_the_rules():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000))
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) + "z" for _ in range(20_000)]
    took = []
    for n in (100, 20_000):
        grader = graders.Grader(tuple((i, 0, "lacks", w, 0) for i, w in enumerate(words[:n])))
        began = time.process_time()
        grader.counts(text)
        took.append(time.process_time() - began)
    assert took[1] < 20 * max(took[0], 0.01)


def test_lost_letters_need_unique_evidence(spark):
    body = [(1, "Wonderful things"), (2, "wonderful"), (3, "wonderful Things"), (4, "Woderful thngs and wonderul"), (5, "planters"), (6, "planters"), (7, "planters"), (8, "plantars"), (9, "plantars"), (10, "plantars"), (11, "plantrs here"), (12, None), (13, "things"), (14, "")]
    fixed, found = gaps.repaired(spark.createDataFrame(body, "id long, body string"))
    got = {r.id: r.repaired for r in fixed.collect()}
    assert got[4] == "Wonderful things and wonderful" or got[4] == "Wonderful thngs and wonderful"
    assert got[11] == "plantrs here"  # two words are as strong
    assert got[12] is None and got[14] == "" and got[1] == "Wonderful things"
    assert {(r.id, r.word, r.repaired) for r in found.collect()} >= {(4, "woderful", "wonderful"), (4, "wonderul", "wonderful")}
