"""Secret scans with one minimal automaton for all rules.

Each rule is a sequence of byte classes with repeat counts. Thompson's construction, the subset construction and
Moore's minimisation turn all rules together into transition arrays; one pass over the bytes then finds where a
match of any rule ends. The pass runs on many pieces of the text at once, cut behind bytes that lead every state
back to the start, so that no cut can change a match. Where such bytes are far apart, as in a long line of one word, pieces
go on from each other: each is run from every state in which such a piece can end, and these maps of states are put
together in order. The reversed rule, run back from an end, gives the start; where a state stays as it is over a run of
bytes, the run is one step.

Rules end in an open repeat, so a match reaches as far as its last class does and the leftmost longest match is
the one that a leftmost search gives. Matches of one kind do not overlap.

Defined cases: null and empty texts hold no secrets. Texts and lines of any length are scanned whole. Repeated rows are each
scanned. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_slices

DIGIT, UPPER, LOWER = frozenset(b"0123456789"), frozenset(range(65, 91)), frozenset(range(97, 123))
ALNUM = DIGIT | UPPER | LOWER

#: One item of a rule: a byte class, its least count, and its greatest count (None: open).
Item = tuple[frozenset, int, int | None]


def word(text: str, any_case: bool = False) -> list[Item]:
    """A literal, in either case if asked."""
    return [(frozenset(b for x in ({c.lower(), c.upper()} if any_case else {c}) for b in x.encode()), 1, 1) for c in text]


def one(chars: frozenset, least: int = 1, most: int | None = 1) -> list[Item]:
    return [(chars, least, most)]


SPACES, QUOTE, VALUE = one(frozenset(b" "), 0, None), one(frozenset(b"\"'"), 0, 1), ALNUM | frozenset(b"+/_.=-")

#: Kinds in the order in which they are listed; each is a list of alternatives. The first three are the base rules.
RULES: dict[str, list[list[Item]]] = {
    "assign": [
        w + QUOTE + SPACES + one(frozenset(b":=")) + SPACES + QUOTE + one(VALUE, 1, None)
        for w in (*(word(k, True) for k in ("password", "passwd", "secret", "token")), word("api", True) + one(frozenset(b"_"), 0, 1) + word("key", True))
    ],
    "access": [word("AKIA") + one(DIGIT | UPPER, 1, None)],
    "hex": [one(DIGIT | frozenset(b"abcdef"), 8, None)],
    "github": [word("gh") + one(frozenset(b"oprsu")) + word("_") + one(ALNUM, 1, None)],
    "slack": [word("xox") + one(frozenset(b"abprs")) + word("-") + one(ALNUM | frozenset(b"-"), 1, None)],
    "google": [word("AIza") + one(ALNUM | frozenset(b"_-"), 1, None)],
    "pem": [word("-----BEGIN ") + one(UPPER | frozenset(b" "), 0, None) + word("PRIVATE KEY-") + one(frozenset(b"-"), 1, None)],
}
KINDS = tuple(RULES)
#: Matches shorter than this are dropped after the leftmost search; counting so far inside the automaton would
#: multiply its states. (``hex`` counts to 8 inside it, since nearly every word ends a shorter match.)
LEAST = {"access": 20, "hex": 24, "github": 34, "slack": 16, "google": 34, "pem": 30}
#: The last class of an ``assign`` match is its value, of which that many characters are needed.
LEAST_VALUE = 6
BASE = 3


@dataclass(frozen=True)
class Automaton:
    """``step[state, class_of[byte]]`` is the next state; ``accepts`` has a bit for each kind that ends here; 0 is the start."""

    class_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray


def thompson(rules: list[tuple[int, list[Item]]]) -> tuple[list[dict[int, set[int]]], list[set[int]], dict[int, int]]:
    """Moves by byte, empty moves, and the kind that each accepting state ends; state 0 is the start."""
    moves: list[dict[int, set[int]]] = [{}]
    free: list[set[int]] = [set()]

    def new() -> int:
        moves.append({})
        free.append(set())
        return len(moves) - 1

    ends: dict[int, int] = {}
    for kind, items in rules:
        at = new()
        free[0].add(at)
        for chars, least, most in items:
            for k in range(max(least, 1 if most is None else most)):
                to = new()
                for b in chars:
                    moves[at].setdefault(b, set()).add(to)
                if k >= least:
                    free[at].add(to)
                if most is None and k == max(least, 1) - 1:
                    for b in chars:
                        moves[to].setdefault(b, set()).add(to)
                at = to
        ends[at] = kind
    return moves, free, ends


def determinise(rules: list[tuple[int, list[Item]]], anywhere: bool) -> Automaton:
    """Subset construction, then minimisation by refining classes of equal states."""
    moves, free, ends = thompson(rules)

    def closed(state: int) -> int:
        seen, todo = 1 << state, [state]
        while todo:
            for s in free[todo.pop()]:
                if not seen >> s & 1:
                    seen |= 1 << s
                    todo.append(s)
        return seen

    closure = [closed(s) for s in range(len(moves))]
    signature: dict[tuple, int] = {}
    class_of, sample = np.zeros(256, np.intp), []
    for b in range(256):
        key = tuple((s, tuple(sorted(m[b]))) for s, m in enumerate(moves) if b in m)
        if key not in signature:
            signature[key] = len(sample)
            sample.append(b)
        class_of[b] = signature[key]
    # sets of states are the bits of an integer; to[s] has the states behind s for each class that leads on
    to = [[(c, sum({1 << u for t in m[b] for u in range(len(moves)) if closure[t] >> u & 1})) for c, b in enumerate(sample) if b in m] for m in moves]

    def members(bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out

    first = closure[0]
    index, order, table = {first: 0}, [first], []
    for state in order:  # grows while it runs
        row = [first if anywhere else 0] * len(sample)
        for s in members(state):
            for c, more in to[s]:
                row[c] |= more
        for key in row:
            if key not in index:
                index[key] = len(order)
                order.append(key)
        table.append([index[key] for key in row])
    final = sum(1 << s for s in ends)
    order = [members(state & final) for state in order]
    step = np.array(table, np.int64)
    accepts = np.array([sum(1 << k for k in {ends[s] for s in state}) for state in order], np.int64)
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        named: dict[bytes, int] = {}
        finer = np.array([named.setdefault(row.tobytes(), len(named)) for row in np.column_stack([part, part[step]])])
        if finer.max() == part.max():
            break
        part = finer
    # number the classes in order of their first state, so that the start is 0
    _, firsts = np.unique(part, return_index=True)
    rank = np.argsort(np.argsort(firsts))
    kept = np.sort(firsts)
    return Automaton(class_of, rank[part[step[kept]]].astype(np.int32), accepts[kept])


@lru_cache(maxsize=1)
def compiled() -> tuple[Automaton, list[Automaton]]:
    """The automaton of all rules, and for each kind that of its reversed alternatives."""
    forward = determinise([(k, items) for k, kind in enumerate(KINDS) for items in RULES[kind]], anywhere=True)
    return forward, [determinise([(0, items[::-1]) for items in RULES[kind]], anywhere=False) for kind in KINDS]


def walk(classes: np.ndarray, starts: np.ndarray, length: np.ndarray, first: np.ndarray, auto: Automaton) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The state in which each piece ends that begins in its ``first`` state, and (piece, place, kinds) of matches that stop being one."""
    width = auto.step.shape[1]
    order = np.argsort(-length, kind="stable")
    begin, size = starts[order], length[order]
    flat, accepts = (auto.step * width).ravel(), auto.accepts
    state = first[order] * width
    before = accepts[first[order]]
    any_before = bool(before.any())
    last, events = np.zeros(len(starts), np.int32), []
    live = len(begin)
    for k in range(int(size[0]) if len(size) else 0):
        to = int(np.searchsorted(-size, -k, side="left"))  # pieces longer than k
        if to < live:
            last[order[to:live]] = state[to:live] // width
            live = to
        state = flat[state[:live] + classes[begin[:live] + k]]
        now = accepts[state // width]
        if any_before:
            gone = before[:live] & ~now
            at = np.flatnonzero(gone)
            if len(at):
                events.append((order[at], begin[at] + k, gone[at]))
        before, any_before = now, bool(now.any())
    last[order[:live]] = state[:live] // width
    return last, events


def ends_of(data: np.ndarray, auto: Automaton, piece: int = 2048) -> list[tuple[int, int]]:
    """(end, kind) of every place where a match of a kind stops being one, in order; the last byte must be a reset."""
    resets = (auto.step == 0).all(axis=0)
    classes = auto.class_of[data].astype(np.int32)
    at = np.flatnonzero(resets[classes]) + 1
    cuts = np.unique(np.concatenate([[0], at[np.unique(np.searchsorted(at, np.arange(piece, len(data), piece)).clip(0, len(at) - 1))], [len(data)]]))
    # long stretches without a reset are cut anywhere: those pieces go on from the piece before
    more = [np.arange(a + piece, b, piece) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 2 * piece]
    all_cuts = np.unique(np.concatenate([cuts, *more])).astype(np.int64)
    starts, length = all_cuts[:-1], np.diff(all_cuts)
    goes_on = np.flatnonzero(~np.isin(starts, cuts))
    last, events = walk(classes, starts, length, np.zeros(len(starts), np.int32), auto)
    found = [(lane, place, gone, 0) for lane, place, gone in events]
    # a piece that goes on is run from every state in which a piece before it may end; these are few and soon closed
    maps, todo = {0: last[goes_on]}, set(np.unique(last[goes_on - 1]).tolist())
    while todo := todo - maps.keys():
        state = min(todo)
        maps[state], events = walk(classes, starts[goes_on], length[goes_on], np.full(len(goes_on), state, np.int32), auto)
        found += [(goes_on[lane], place, gone, state) for lane, place, gone in events]
        todo |= set(np.unique(maps[state]).tolist())
    first = np.zeros(len(starts), np.int32)
    for k, piece_at in enumerate(goes_on.tolist()):
        first[piece_at] = last[piece_at - 1]
        last[piece_at] = maps[int(first[piece_at])][k]
    ended: list[tuple[int, int]] = []
    for lane, place, gone, of in found:
        good = first[lane] == of  # of each piece the run from its own state counts
        for where, bits in zip(place[good].tolist(), gone[good].tolist(), strict=True):
            ended += [(where, kind) for kind in range(len(KINDS)) if bits >> kind & 1]
    return sorted(ended)


def run_start(data: np.ndarray, at: int, floor: int, stays: np.ndarray) -> int:
    """The least place from which all bytes up to ``at`` leave the state as it is; windows grow, so a run costs its length."""
    width = 64
    while at > floor:
        low = max(floor, at - width)
        other = np.flatnonzero(~stays[data[low:at]])
        if len(other):
            return low + int(other[-1]) + 1
        at, width = low, width * 4
    return at


def start_of(data: bytes, view: np.ndarray, end: int, floor: int, auto: Automaton, stays: np.ndarray) -> int:
    """The leftmost start, not before ``floor``, of a match that ends at ``end``; -1 if there is none."""
    state, best, at = 0, -1, end
    step, class_of, accepts = auto.step, auto.class_of, auto.accepts
    while at > floor:
        to = step[state, class_of[data[at - 1]]]
        if to == state:
            at = run_start(view, at, floor, stays[state])
        else:
            state = to
            at -= 1
        if accepts[state]:
            best = at
        elif stays[state].all():  # dead
            break
    return best


NAME_BYTES = ALNUM | frozenset(b"_")


def long_enough(data: bytes, start: int, end: int, kind: int) -> bool:
    """Whether a match has the length that its kind needs."""
    if KINDS[kind] != "assign":
        return end - start >= LEAST.get(KINDS[kind], 0)
    at = start
    while data[at] in NAME_BYTES:  # the name, up to a quote, space or sign
        at += 1
    at += data[at] in b"\"'"
    while data[at] == 32:
        at += 1
    at += 1  # the sign
    while data[at] == 32:
        at += 1
    at += data[at] in b"\"'"
    return end - at >= LEAST_VALUE


def scan(texts: list[str], automata: tuple[Automaton, list[Automaton]] | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's secrets in code points, in order."""
    forward, backward = automata or compiled()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    floor: dict[tuple[int, int], int] = {}
    view = np.frombuffer(data, np.uint8)
    # by kind, state and byte: whether the reversed rule stays in the state
    stays = [(auto.step == np.arange(len(auto.step))[:, None])[:, auto.class_of] for auto in backward]
    for end, kind in ends_of(view, forward):
        doc = int(np.searchsorted(bounds, end, side="right")) - 1
        low = floor.get((doc, kind), int(bounds[doc]))
        start = start_of(data, view, end, low, backward[kind], stays[kind])
        if start >= 0:
            floor[doc, kind] = end
            if not long_enough(data, start, end, kind):
                continue
            found[doc].append((start - int(bounds[doc]), kind, end - int(bounds[doc])))
    for doc, spans in enumerate(found):
        if spans and not raw[doc].isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(raw[doc], np.uint8) & 0xC0) != 0x80)])
            found[doc] = [(int(points[a]), kind, int(points[b])) for a, kind, b in spans]
        found[doc].sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ARROW = pa.schema([("doc_id", pa.int64()), ("secrets", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``secrets``, an array of (kind, start, end) in code points, by start, then kind."""
    automata = compiled()  # on the driver, once; tasks get the arrays

    def run(part):
        spans = scan([t or "" for t in part.column(1).to_pylist()], automata)
        return {"doc_id": part.column(0), "secrets": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans]}

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>", ARROW, 1, 4 << 20)


