"""Secret scan: one byte pass of a combined automaton, then exact spans where a rule ended.

All rules are compiled into one deterministic minimal automaton (``automaton``). A pass over
the UTF-8 bytes of a text notes where a match of a rule can first end. Only at those places the span is made
exact: the rule's backward automaton finds the leftmost start, its forward automaton the
longest end. Matches of a rule are leftmost and do not overlap; a match that fails the
rule's length is dropped but still used up.

A rule needs: at one start there is one way to match but for the length, and no match lies
whole inside the part of another before that one can first end. The given rules have this.

Defined results: null text counts as empty and has no spans (empty text for ``spans``);
equal rows get equal results; spans are code points with the end exclusive, by start, then
in the order of rules. Texts of any length are read whole; memory follows one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.automaton import Automaton, compile_rules, parse
from tidegrid.llm.common import field, map_texts, unused


@dataclass(frozen=True)
class Rule:
    """``value``: a prefix pattern; ``least`` counts what follows it, or the whole match without one."""

    kind: str
    pattern: str
    least: int
    prefix: str = ""
    ignore_case: bool = False


# The base rules. A hex run shorter than 16 is dropped, so the pattern itself asks for 16.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=\-]+", 12, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
# Further public token forms.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)
RULES = BASE + MORE


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    combined: Automaton
    forward: list[Automaton]
    backward: list[Automaton]
    prefix: list[Automaton | None]


def _tree(rule: Rule):
    # Letters of the prefix in either case; the value's class is as written.
    parts = [parse(rule.prefix, rule.ignore_case)] if rule.prefix else []
    return ("seq", [*parts, parse(rule.pattern)])


def _shortest(tree):
    """The tree without the last repetitions beyond the least: it ends where a match can first end."""
    kind = tree[0]
    if kind == "repeat":
        return ("repeat", tree[1], tree[2], tree[2])
    if kind == "seq":
        parts = list(tree[1])
        while parts and parts[-1][0] == "repeat" and parts[-1][2] == 0:
            parts.pop()
        return ("seq", [*parts[:-1], _shortest(parts[-1])] if parts else [])
    return tree


def build(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [_tree(r) for r in rules]
    return Scanner(rules, compile_rules([_shortest(t) for t in trees], True), [compile_rules([t], False) for t in trees],
                   [compile_rules([t], False, backwards=True) for t in trees],
                   [compile_rules([parse(r.prefix, r.ignore_case)], False) if r.prefix else None for r in rules])


def _longest(automaton: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    rows, ends, state, best = automaton.rows, automaton.ends, automaton.start, -1
    dead = _dead(automaton)
    for i in range(at, len(data)):
        state = rows[state][data[i]]
        if ends[state]:
            best = i + 1
        elif state == dead:
            break
    return best


def _first_start(automaton: Automaton, data: bytes, end: int, floor: int) -> int:
    """Leftmost start, not before ``floor``, of a match that ends at ``end``, or -1."""
    rows, ends, state, best = automaton.rows, automaton.ends, automaton.start, -1
    dead = _dead(automaton)
    for i in range(end - 1, floor - 1, -1):
        state = rows[state][data[i]]
        if ends[state]:
            best = i
        elif state == dead:
            break
    return best


def _dead(automaton: Automaton) -> int:
    """The state that no byte leaves and at which nothing ends, or -1."""
    found = getattr(automaton, "_dead", None)
    if found is None:
        found = next((s for s, row in enumerate(automaton.rows) if not automaton.ends[s] and set(row) == {s}), -1)
        automaton._dead = found
    return found


def events(scanner: Scanner, data: bytes) -> list[tuple[int, int]]:
    """(end, rules that can first end there), from one pass over the bytes."""
    rows, first = scanner.combined.rows, scanner.combined.first_end
    ends, state, out = scanner.combined.ends, scanner.combined.start, []
    for at, byte in enumerate(data, 1):
        state = rows[state][byte]
        if state >= first:
            out.append((at, ends[state]))
    return out


def spans(scanner: Scanner, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then in the order of rules."""
    if not text:
        return []
    data = text.encode("utf-8", "replace")
    hits = events(scanner, data)
    if not hits:
        return []
    found = []
    for k, rule in enumerate(scanner.rules):
        done = 0
        for end, mask in hits:
            if not mask >> k & 1 or end <= done:
                continue
            start = _first_start(scanner.backward[k], data, end, done)
            if start < 0:
                continue
            done = _longest(scanner.forward[k], data, start)
            counted = _longest(scanner.prefix[k], data, start) if scanner.prefix[k] else start
            if done - counted >= rule.least:
                found.append((start, k, done))
    found.sort()
    if len(data) == len(text):
        return [(a, b, scanner.rules[k].kind) for a, k, b in found]
    # Code points before each edge: the bytes before it that begin one, all edges at once.
    begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    points = np.searchsorted(begins, np.array([(a, b) for a, _, b in found], np.int64).reshape(-1, 2)).tolist()
    return [(a, b, scanner.rules[k].kind) for (a, b), (_, k, _) in zip(points, found)]



def scan(df: DataFrame, keep, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` plus spans of every whole text as parallel arrays: span_kind, span_start, span_end."""
    scanner = build(rules)

    def start():
        def work(texts):
            found = [spans(scanner, t) for t in texts]
            return [[[s[2] for s in f] for f in found], [[s[0] for s in f] for f in found],
                    [[s[1] for s in f] for f in found]]
        return work

    return map_texts(df, keep, text, [field("span_kind", "array<string>"), field("span_start", "array<bigint>"),
                                      field("span_end", "array<bigint>")], start)


def _texts_of(kinds: tuple[str, ...] | None = None) -> Column:
    each = F.arrays_zip("span_kind", "span_start", "span_end")
    if kinds is not None:
        each = F.filter(each, lambda x: x["span_kind"].isin(*kinds))
    return F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["span_kind"], x["span_start"].cast("string"),
                                                                x["span_end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("span_kind", lambda x: x == kind)).cast("long")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    found = scan(df, ["doc_id"])
    base = tuple(r.kind for r in BASE)
    return found.select("doc_id", *(_count(k).alias(f"n_{k}")
                                    for k in base),
                        F.sha2(_texts_of(base), 256).alias("base_sha256"), _texts_of().alias("spans"))


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with each span (overlapping ones joined) replaced by ``[kind]``; the length follows. Other rows stay as they are."""
    scanner = build(rules)

    def clean(value):
        out, at = [], 0
        for a, b, kind in spans(scanner, value):
            if a >= at:
                out += [value[at:a], f"[{kind}]"]
            at = max(at, b)
        return value if not out else "".join([*out, value[at:]])

    def start():
        return lambda texts: [[clean(t) for t in texts]]

    name = unused("_clean_text", df.columns)
    out = map_texts(df, df.columns, text, [field(name, "string")], start)
    changed = ~F.col(name).eqNullSafe(F.col(f"`{text}`"))
    new = {text: F.col(name)}
    if n_chars in df.columns:
        new[n_chars] = F.when(changed, F.length(name)).otherwise(F.col(f"`{n_chars}`")).cast(df.schema[n_chars].dataType)
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))
