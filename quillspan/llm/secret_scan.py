"""Secret scans by one combined deterministic automaton.

All rules are compiled together on the driver: regular expressions become one
nondeterministic automaton of their reversals, subset construction makes it deterministic,
Moore's refinement minimises it, and what comes out is a transition array over classes of
bytes. A text is read once, byte by byte from its end, by this array; a state's bits say
which rules have a match that starts at this byte. From the leftmost start a rule's own small automaton
finds the longest end, and the search goes on behind it: leftmost, non-overlapping matches
per rule. A rule's last step drops matches whose match (or group) is too short; such a match
has still used up its text.

The texts of a block stand one after the other, with a byte between them that UTF-8 never
holds and that leads back to the first state. The block is cut into lanes, which one array step
advances together, each guessing that it begins in the first state. A lane whose
neighbour ends in another state is read again from there until the states agree, so the result is
that of one sequential pass, and a text of any length needs no more than the block.

Rules are regular expressions over ASCII (classes, groups, alternatives, ?, *, + and counts)
for which the longest match is the first one; `compile_rules` refuses anything else.
The automaton's size depends on the rules alone, and it travels with the tasks.

Defined cases: null and empty texts have no spans. Repeated rows and rows of a null doc_id are
reported one by one. Spans of different rules may overlap; ties in the start are in the order
of the rules. Very long texts are scanned whole. An empty table gives an empty one. Other
columns, whatever their names, pass through `redact` untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of the match, or of `group`
    group: int = 0


# The first three rules are those of the contract (`hex` counts its 16 in the pattern).
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]+", 32),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?-----", 0),
    Rule("url", r"[a-z]+://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@", 12),
)

SEPARATOR = 0xFF
BLOCK = 2_000_000


class Nfa:
    """Thompson's construction; `moves` and `skips` by state. Reversed when `backwards`."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.skips: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, backwards: bool) -> int:
        """States for a parsed expression behind `start`; returns the last one."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            start = self._item(op, arg, start, backwards)
        return start

    def _item(self, op, arg, start: int, backwards: bool) -> int:
        if op in (sre.LITERAL, sre.IN):
            end = self.state()
            self.moves[start].append((frozenset(_characters(op, arg)), end))
            return end
        if op is sre.SUBPATTERN:
            _, on, off, inner = arg
            if off or on & ~re.IGNORECASE:
                raise ValueError("only the flag i is known")
            return self.add([_both_cases(x) for x in inner] if on & re.IGNORECASE else inner, start, backwards)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                first = self.state()
                self.skips[start].append(first)
                self.skips[self.add(branch, first, backwards)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, backwards)
            if most is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.skips[start] += [loop, end]
                self.skips[self.add(inner, loop, backwards)] += [loop, end]
                return end
            ends = [start]
            for _ in range(most - least):
                ends.append(self.add(inner, ends[-1], backwards))
            end = self.state()
            for e in ends:
                self.skips[e].append(end)
            return end
        raise ValueError(f"unknown in a rule: {op}")


def _characters(op, arg) -> set[int]:
    if op is sre.LITERAL:
        found = {arg}
    else:
        found = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(value)
            elif kind is sre.RANGE:
                found |= set(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"unknown in a class: {kind}")
    if max(found) > 127:
        raise ValueError("rules are of ASCII characters")
    return found


def _both_cases(item):
    """A parsed item with its letters in either case."""
    op, arg = item
    if op in (sre.LITERAL, sre.IN):
        found = _characters(op, arg)
        return sre.IN, [(sre.LITERAL, ord(x)) for c in sorted(found) for x in {chr(c).lower(), chr(c).upper()}]
    if op is sre.SUBPATTERN:
        return op, (*arg[:3], [_both_cases(x) for x in arg[3]])
    if op is sre.BRANCH:
        return op, (arg[0], [[_both_cases(x) for x in b] for b in arg[1]])
    if op is sre.MAX_REPEAT:
        return op, (*arg[:2], [_both_cases(x) for x in arg[2]])
    return item


@dataclass
class Dfa:
    """next[state * width + code] of a byte's code; accepts[state] is a set of rules as bits. State 0 is the first."""

    codes: np.ndarray
    width: int
    next: np.ndarray
    accepts: np.ndarray


def determine(nfa: Nfa, start: int, ends: dict[int, int], search: bool) -> Dfa:
    """Subset construction over classes of bytes, then minimisation. search: a match may begin anywhere."""
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    names: dict[tuple, int] = {}
    codes = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], np.uint8)
    held = [[k for k, name in enumerate(names) if name[sets.index(s)]] for s in sets]
    at = {s: i for i, s in enumerate(sets)}

    closures: dict[int, frozenset] = {}

    def closure(state: int) -> frozenset:
        if state not in closures:
            seen, stack = {state}, [state]
            while stack:
                for t in nfa.skips[stack.pop()]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            # only states that move or accept tell subsets apart
            closures[state] = frozenset(s for s in seen if nfa.moves[s] or s in ends)
        return closures[state]

    first = closure(start)
    known, order, rows = {first: 0}, [first], []
    for subset in order:
        targets: list[set] = [set(first) if search else set() for _ in names]
        for s in subset:
            for letters, t in nfa.moves[s]:
                for k in held[at[letters]]:
                    targets[k] |= closure(t)
        row = []
        for t in map(frozenset, targets):
            if t not in known:
                known[t] = len(order)
                order.append(t)
            row.append(known[t])
        rows.append(row)
    accepts = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)
    return minimise(codes, np.array(rows, np.int64), accepts)


def minimise(codes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Moore's refinement: states are told apart by what they accept, then by the classes that follow, until nothing changes."""
    group = np.unique(accepts, return_inverse=True)[1]
    n = group.max() + 1
    while True:
        group = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if group.max() + 1 == n:
            break
        n = group.max() + 1
    _, first = np.unique(group, return_index=True)  # a state of each class
    names = np.argsort(np.argsort(first))  # numbered by first appearance, so that the first state stays 0
    small = np.empty((n, table.shape[1]), np.int64)
    small[names] = names[group[table[first]]]
    found = np.empty(n, np.int64)
    found[names] = accepts[first]
    return Dfa(codes, table.shape[1], small.ravel(), found)


@dataclass
class Scanner:
    rules: tuple
    starts: Dfa  # of all rules, reversed
    ends: list  # a rule's states as tuples over bytes: (next states, whether a match may end)


def compile_rules(rules: tuple = RULES) -> Scanner:
    nfa, ends, forward = Nfa(), {}, []
    start = nfa.state()
    for k, rule in enumerate(rules):
        tree = _parser.parse(rule.pattern)
        first = nfa.state()
        nfa.skips[start].append(first)
        ends[nfa.add(tree, first, backwards=True)] = 1 << k
        own = Nfa()
        begin = own.state()
        dfa = determine(own, begin, {own.add(tree, begin, backwards=False): 1}, search=False)
        wide = dfa.next.reshape(-1, dfa.width)[:, dfa.codes]
        if dfa.accepts[0]:
            raise ValueError(f"rule {rule.kind} matches nothing at all")
        dead = [i for i, row in enumerate(wide) if (row == i).all() and not dfa.accepts[i]]
        wide[np.isin(wide, dead)] = -1
        forward.append([(tuple(row), bool(a)) for row, a in zip(wide.tolist(), dfa.accepts.tolist(), strict=True)])
    return Scanner(tuple(rules), determine(nfa, start, ends, search=True), forward)


def match_starts(dfa: Dfa, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bits): where matches begin, and of which rules, by one pass over the bytes from their end."""
    n = len(data)
    lanes = int(np.clip(n // 64, 1, 4096))
    size = -(-n // lanes)
    lanes = -(-n // size)
    padded = np.full(lanes * size, SEPARATOR, np.uint8)
    padded[:n] = data
    codes = np.ascontiguousarray(dfa.codes[padded].reshape(lanes, size).T)
    table = (dfa.next * dfa.width).astype(np.int64)  # states are kept multiplied
    trace = np.empty((size, lanes), np.int32)
    state = np.zeros(lanes, np.int64)
    for j in range(size - 1, -1, -1):
        state = table.take(state + codes[j])
        trace[j] = state
    # lanes that began in a wrong state are read again until the states agree
    begin = np.zeros(lanes, np.int64)
    while True:
        true = np.append(trace[0, 1:], 0).astype(np.int64)
        wrong = np.flatnonzero(true != begin)
        if not len(wrong):
            break
        begin, state = true, true[wrong]
        for j in range(size - 1, -1, -1):
            state = table.take(state + codes[j, wrong])
            differs = trace[j, wrong] != state
            wrong, state = wrong[differs], state[differs]
            if not len(wrong):
                break
            trace[j, wrong] = state
    speaks = np.zeros(len(table), bool)  # states as they are kept
    speaks[:: dfa.width] = dfa.accepts != 0
    places = np.flatnonzero(speaks.take(trace.T))
    return places, dfa.accepts[trace.T.ravel()[places] // dfa.width]


def _longest(states: list, data: bytes, at: int) -> int:
    """The longest end of a match that begins at a place where one does."""
    row, end, i, n = states[0][0], at, at, len(data)
    while i < n:
        s = row[data[i]]
        if s < 0:
            break
        i += 1
        row, accepts = states[s]
        if accepts:
            end = i
    return end


def scan(scanner: Scanner, texts: list) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text, in code points, by start and then by the order of the rules."""
    found: list[list] = [[] for _ in texts]
    groups = [re.compile(r.pattern) if r.group else None for r in scanner.rules]
    for a, b in text_blocks(texts, BLOCK):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = bytes([SEPARATOR]).join(raw)
        if not data:
            continue
        heads = np.cumsum([0] + [len(r) + 1 for r in raw]).tolist()
        array = np.frombuffer(data, np.uint8)
        places, bits = match_starts(scanner.starts, array)
        marked = []
        for k, rule in enumerate(scanner.rules):
            starts = places[(bits >> k & 1) == 1].tolist()
            i = 0
            while i < len(starts):
                at = starts[i]
                end = _longest(scanner.ends[k], data, at)
                long = end - at
                if rule.group and long >= rule.least:
                    long = len(groups[k].fullmatch(data[at:end].decode())[rule.group])
                if long >= rule.least:
                    marked.append((at, k, end))
                i = bisect_left(starts, end, i + 1)
        marked.sort()
        doc, read, signs = -1, 0, 0
        for at, k, end in marked:
            while doc < 0 or heads[doc + 1] <= at:
                doc, read, signs = doc + 1, 0, 0
            # bytes up to the match, counted on from the match before
            signs += len(raw[doc][read : at - heads[doc]].decode("utf-8", "surrogatepass"))
            read = at - heads[doc]
            found[a + doc].append((scanner.rules[k].kind, signs, signs + end - at))  # a match is ASCII
    return found


def secret_spans(text, rules: tuple = RULES) -> F.Column:
    """array<struct<kind, start, stop>> of a text column, by start and then by the order of the rules."""
    scanner = compile_rules(rules)

    @F.pandas_udf("array<struct<kind:string,start:int,stop:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in scan(scanner, texts.tolist())], dtype=object)

    return spans(text)


def redact(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The same rows and columns, with `[kind]` in the place of each secret; of overlapping ones, in that of the first."""
    scanner = compile_rules(rules)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for text, marks in zip(values, scan(scanner, values), strict=True):
            if marks:
                pieces, last = [], 0
                for kind, start, end in marks:
                    if start >= last:
                        pieces += [text[last:start], f"[{kind}]"]
                    last = max(last, end)
                text = "".join([*pieces, text[last:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.select(*[cover("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def secret_report(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = docs.select("doc_id", secret_spans(F.col("text"), rules).alias("s"))

    def of(*kinds: str) -> F.Column:
        return F.filter("s", lambda x: x["kind"].isin(*kinds))

    def digest(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(of(*BASE_KINDS)), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"))
