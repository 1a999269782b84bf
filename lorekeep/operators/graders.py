"""Graders: rules about answers, whose literals are one automaton, so that a text is read once however many rules there are."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that a grader takes; every worker holds all of them. More are refused.
MAX_RULES = 200_000
#: Texts whose verdicts are held at once; there are as many for each as its case has rules.
SLICE = 256
#: Kinds of rules: what value and n mean.
KINDS = {
    "has": "value stands in the text", "lacks": "value doesn't", "at most": "value stands there n times at most, not counting overlaps", "ends with": "the last line that isn't blank holds value",
    "matches": "the regular expression value is found", "matches not": "it isn't", "width": "no line is longer than n", "section": "a heading is value",
}
LITERAL = ("has", "lacks", "at most")


class Grader:
    def __init__(self, rules: tuple[tuple, ...]):
        import ahocorasick

        self.by_case: dict = {}
        self.words: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for rule_id, case, kind, value, n in rules:
            if kind in LITERAL and value and value not in self.words:
                self.words[value] = len(self.words)
                self.automaton.add_word(value, (self.words[value], len(value)))
            pattern = re.compile(value) if kind in ("matches", "matches not") else re.compile(rf"^#{{1,6}}[ \t]+{re.escape(value)}[ \t]*$", re.M) if kind == "section" else None
            self.by_case.setdefault(case, []).append((rule_id, kind, value, n, pattern))
        if self.words:
            self.automaton.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """How often each literal stands in a text, overlaps with itself left out."""
        out: dict[int, int] = {}
        until: dict[int, int] = {}
        if self.words:
            for end, (word, size) in self.automaton.iter(text):
                if end - size >= until.get(word, -1):
                    out[word] = out.get(word, 0) + 1
                    until[word] = end
        return out

    def verdicts(self, case, text: str | None) -> list[tuple]:
        """rule and whether the text meets it, for the rules of its case; a null text is empty."""
        rules = self.by_case.get(case)
        if not rules:
            return []
        text = text or ""
        found = self.counts(text) if any(r[1] in LITERAL for r in rules) else {}
        lines = text.split("\n")
        last = next((x for x in reversed(lines) if x.strip()), "")
        out = []
        for rule_id, kind, value, n, pattern in rules:
            if kind in LITERAL:
                times = found.get(self.words[value], 0) if value else 1
                good = times > 0 if kind == "has" else times == 0 if kind == "lacks" else times <= n
            elif kind == "ends with":
                good = value in last
            elif kind == "width":
                good = max(map(len, lines)) <= n
            else:
                good = (pattern.search(text) is not None) != (kind == "matches not")
            out.append((rule_id, good))
        return out


@lru_cache(maxsize=2)
def _grader(rules: tuple) -> Grader:
    return Grader(rules)


def graded(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule_id, passed``: verdicts on texts (``id, case, text``) by the rules (``rule_id, case, kind, value, n``) of their case. No shuffle.

    Raises ValueError for kinds that don't exist and for more than MAX_RULES rules. A text without rules has no row;
    rows that repeat an id are judged each.
    """
    held = tuple(map(tuple, rules.select("rule_id", "case", "kind", F.coalesce("value", F.lit("")).alias("value"), "n").orderBy("case", "rule_id").limit(MAX_RULES + 1).collect()))
    if len(held) > MAX_RULES or {r[2] for r in held} - KINDS.keys():
        raise ValueError(f"at most {MAX_RULES} rules of the kinds {', '.join(KINDS)}")

    def run(batches):
        grader = _grader(held)
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at : at + SLICE]
                rows = [(i, *v) for i, case, text in zip(some["id"].tolist(), some["case"].tolist(), some["text"].tolist()) for v in grader.verdicts(case, text)]
                yield pd.DataFrame(rows, columns=["id", "rule_id", "passed"])

    types = dict(texts.dtypes) | {"rule_id": dict(rules.dtypes)["rule_id"]}
    return texts.select("id", "case", "text").mapInPandas(run, f"id {types['id']}, rule_id {types['rule_id']}, passed boolean")
