"""Secret scans: fixed base rules, and probabilistic automata inferred from what those rules label."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, claim, slices, text_bytes

#: Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: The shortest run that is judged, as short as the shortest value of the base rules.
LEAST_RUN = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)
#: Labelled credentials of a kind that the automata are fitted on, at most.
LABELLED = 600
#: Words whose verdict a task remembers, at most.
REMEMBERED = 500_000
#: Significance of the Hoeffding bound under which two states are told apart.
ALPHA = 0.05
#: Nats in all, and for each symbol, by which a credential automaton must beat the ordinary one.
LEAST_TOTAL, LEAST_EACH = 10.0, 0.35
FLOOR = math.log(1e-4)

_CLASS = {**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
_CLASSES = str.maketrans(_CLASS)
#: Symbols of ordinary words; the end of a word is one more.
ALPHABET = "dxlU+/_.=-"
#: What a symbol is expected to be followed by before any word is seen: itself, mostly.
AGAIN = 0.9


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) of the base rules, in order.

    A run of hexadecimal digits of 24 and more is the only match of the hex rule that is kept, and
    the pattern finds exactly those; the other rules drop matches that are too short afterwards.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of LEAST_RUN and more characters, and of what base spans leave of them."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b in spans:
            if b > at and a < m.end():
                if a - at >= LEAST_RUN:
                    yield at, a
                at = max(at, b)
        if m.end() - at >= LEAST_RUN:
            yield at, m.end()


def words_of(text: str, spans: list[tuple[int, int]]) -> set[str]:
    """The distinct runs of a text."""
    return {text[a:b] for a, b in runs(text, spans)} if spans else set(CANDIDATE.findall(text))


def told(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def symbols(word: str) -> str:
    """Digits, hexadecimal letters, other small letters, capitals; marks stand for themselves."""
    return word.translate(_CLASSES)


class Automaton:
    """A stochastic automaton: prefix-tree states merged where their futures do not differ
    significantly (state merging under a Hoeffding bound)."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.seen = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for word in words:
            state = 0
            for c in symbols(word):
                self.seen[state] += 1
                self.taken[state][c] = self.taken[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = self._state()
                state = self.next[state][c]
            self.seen[state] += 1
            self.ends[state] += 1
        self._merge_states()

    def _state(self) -> int:
        self.next.append({})
        self.taken.append({})
        self.ends.append(0)
        self.seen.append(0)
        return len(self.next) - 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.taken[p].keys() | self.taken[q].keys():
                if self._differ(self.taken[p].get(c, 0), n, self.taken[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state and the states that its words lead to."""
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for c, n in self.taken[q].items():
                self.taken[p][c] = self.taken[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge_states(self) -> None:
        kept, known = [0], {0}
        todo = deque((0, c) for c in sorted(self.next[0]))
        while todo:
            parent, c = todo.popleft()
            state = self.next[parent][c]
            if state in known:
                continue
            for red in kept:
                if self._compatible(red, state):
                    self.next[parent][c] = red
                    self._fold(red, state)
                    todo.extend((r, x) for r in kept for x in sorted(self.next[r]) if self.next[r][x] not in known)
                    break
            else:
                kept.append(state)
                known.add(state)
                todo.extend((state, x) for x in sorted(self.next[state]))
        self.states = kept

    def likelihood(self, word: str, floor: float = -math.inf) -> float:
        """The logarithm of the word's probability; ``floor`` stands for a symbol that no labelled word
        had there, and the state stays."""
        state, total = 0, 0.0
        for c in symbols(word):
            n = self.taken[state].get(c)
            total += math.log(n / self.seen[state]) if n else floor
            state = self.next[state][c] if n else state
        return total


def pairs_of(shapes: Iterable[tuple[str, int]]) -> Counter:
    """How often a symbol follows another one in the symbols of words (shape, count); a word starts after "^" and ends with "$"."""
    every: Counter = Counter()
    for shape, n in shapes:
        every[shape] += n
    found: Counter = Counter()
    for shape, n in every.items():
        for pair in zip("^" + shape, shape + "$", strict=True):
            found[pair] += n
    return found


class Ordinary:
    """The automaton of ordinary words: one state for each symbol, which leads to those seen after it.

    It has no longer memory on purpose. The words it is fitted on may hold credentials that no rule
    labels; a state that only these reach would spell them as well as their own automaton does.
    """

    def __init__(self, pairs: dict[tuple[str, str], int]):
        following = ALPHABET + "$"
        self.log: dict[tuple[str, str], float] = {}
        for c in "^" + ALPHABET:
            total = sum(pairs.get((c, x), 0) for x in following)
            for x in following:
                prior = 1 / len(following) if c == "^" else AGAIN if x == c else (1 - AGAIN) / (len(following) - 1)
                self.log[c, x] = max(FLOOR, math.log((pairs.get((c, x), 0) + prior) / (total + 1)))

    def likelihood(self, word: str) -> float:
        """The logarithm of the probability of the word's symbols."""
        shape = symbols(word)
        found = sum(map(self.log.__getitem__, zip("^" + shape, shape)))
        if len(set(shape)) > 1:
            return found
        # a run of one kind of symbols, such as a long number, is ordinary at any length
        return max(found, self.log["^", shape[0]] + (len(shape) - 1) * math.log(AGAIN))


class Formats:
    """The automata of all credential kinds against that of ordinary words (a list of them, or pairs
    counted). A word that no automaton of a kind can spell is no credential."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str] | dict[tuple[str, str], int]):
        self.formats = [Automaton(sorted(words)) for _, words in sorted(labelled.items()) if words]
        self.ordinary = Ordinary(ordinary if isinstance(ordinary, dict) else pairs_of((symbols(w), 1) for w in ordinary))
        self.known: dict[str, bool] = {}

    def credential(self, word: str) -> bool:
        if not self.formats:
            return False
        best = max(f.likelihood(word) for f in self.formats)
        gain = best - self.ordinary.likelihood(word) if best > -math.inf else best
        return gain >= LEAST_TOTAL and gain >= LEAST_EACH * len(word)

    def added(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(start, end) of the credentials beside the base spans."""
        if not self.formats:
            return []
        words = words_of(text, spans)
        if len(self.known) >= REMEMBERED:
            self.known = {}
        for word in words:
            if word not in self.known:
                self.known[word] = self.credential(word)
        if not any(map(self.known.__getitem__, words)):
            return []
        return [(a, b) for a, b in runs(text, spans) if self.credential(text[a:b])]


def learn_formats(docs: DataFrame, scratch: Scratch, text_col: str = "text", most: int = LABELLED) -> Formats:
    """Automata from a bounded sample of distinct labelled credentials (those of the smallest hashes),
    and of ordinary words: all runs of all documents, each counted in every document but its first.

    A key that no rule labels is in one document and so says nothing of ordinary words, however many
    such keys there are. What comes to the driver of the words is a count for each pair of symbols.
    """

    key = uuid.uuid4().bytes

    def named(word: str) -> str:
        """A word as it is written: a keyed hash and its symbols, which tell no key that no rule labels."""
        return hashlib.blake2b(word.encode(), digest_size=10, key=key).hexdigest() + symbols(word)

    def rows(kinds: list[int], words: Iterable[str], counts: Iterable[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["kind", "word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                kinds, secrets = [], []
                for body in part.column("body").to_pylist():
                    text = body.decode("utf-8", "replace")
                    found = base_spans(text)
                    kinds += [k for _, k, _, _ in found]
                    secrets += [s for _, _, _, s in found]
                    words.update(words_of(text, [(a, b) for a, _, b, _ in found]))
                yield rows(kinds, secrets, [1] * len(kinds))
                if len(words) > REMEMBERED:
                    yield rows([3] * len(words), list(map(named, words)), list(words.values()))
                    words.clear()
        yield rows([3] * len(words), list(map(named, words)), list(words.values()))

    def shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            pairs.update(pairs_of(zip((w[20:] for w in batch.column("word").to_pylist()), batch.column("n").to_pylist(), strict=True)))
        yield rows([3] * len(pairs), ["".join(p) for p in pairs], list(pairs.values()))

    seen = scratch.table(docs.select(text_bytes(text_col).alias("body")).mapInArrow(run, "kind int, word string, n long"), "secrets")

    def sample(words: DataFrame) -> list[str]:
        return [r["word"] for r in words.distinct().orderBy(F.xxhash64("word"), "word").limit(most).collect()]

    try:
        labelled = {KINDS[k]: sample(seen.filter(F.col("kind") == k).select("word")) for k in range(3)}
        words = seen.filter("kind = 3").groupBy("word").agg((F.sum("n") - 1).alias("n")).filter("n > 0")
        pairs = words.mapInArrow(shapes, "kind int, word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    finally:
        scratch.drop(seen)  # it holds labelled credentials in plain
    return Formats(labelled, {(r["word"][0], r["word"][1]): r["n"] for r in pairs})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: Formats | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar of every whole text.

    The base rules label credentials; automata inferred from them then judge every other run of
    LEAST_RUN and more credential characters, also what base spans leave of one, and add spans of kind
    ``grammar`` (listed last). Null text counts as empty; null ids, ties and repeated rows are rows
    like any other; an empty table, or one without labelled credentials, gets no added spans; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    formats = formats or learn_formats(docs, scratch, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                counts, digests, spans, added = [], [], [], []
                for body in part.column("body").to_pylist():
                    text = body.decode("utf-8", "replace")
                    found = [(a, k, b) for a, k, b, _ in base_spans(text)]
                    kinds = [k for _, k, _ in found]
                    new = [(a, 3, b) for a, b in formats.added(text, [(a, b) for a, _, b in found])]
                    counts.append([kinds.count(k) for k in range(3)])
                    digests.append(hashlib.sha256(told(found).encode()).hexdigest())
                    spans.append(told(sorted(found + new)))
                    added.append(len(new))
                columns = [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span of their text replaced by ``mark``; all other columns stay.

    The automata are learned from the same documents. Null text stays null.
    """
    formats = learn_formats(docs, Scratch(docs.sparkSession), text_col)

    return docs.withColumn(text_col, _arrow_text(lambda text: redacted(text, formats, mark))(F.col(text_col)))


def redacted(text: str, formats: Formats, mark: str) -> str:
    base = [(a, b) for a, _, b, _ in base_spans(text)]
    spans = sorted(base + formats.added(text, sorted(base)))
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _arrow_text(f):
    @F.arrow_udf("string")
    def mapped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return mapped
