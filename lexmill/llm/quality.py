"""Quality rules as a short-circuit cascade.

A rule looks at a batch of texts and says which ones it rejects. Rules share lazily computed
columns of the batch (words, line hashes), so what one rule has computed the next one need
not. Costs (seconds of each column and of each rule's own work) and the patterns of
rejection are measured on a bounded sample by a Spark job. The order is greedy: next comes
the rule that rejects most of what is left for each second that it adds, columns that are
there already being free. Each rule then sees only the documents that every rule before it
let through. The verdict does not depend on the order; only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import small_batches

U64 = np.uint64
PIECE = 1 << 20
#: hashes meet within one text alone, so each worker has a key of its own
_KEY = wh.fresh_key()
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _marks(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many marked bytes each document has."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), off))


class Texts:
    """Some texts of a batch, with what rules ask of them, computed once at first use."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self._have = data, off, {}
        self._seconds, self._needs, self._open = {}, {}, []  # of each column: seconds without those that it asked for, and which it asked for

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, alive: np.ndarray) -> "Texts":
        """Only some of the texts; columns that are there already are cut, not computed again."""
        if alive.all():
            return self
        size = np.diff(self.off)
        off = np.concatenate(([0], np.cumsum(size[alive])))
        out = Texts(self.data[np.repeat(alive, size)], off)
        out._have = {k: v[alive] for k, v in self._have.items() if isinstance(v, np.ndarray) and len(v) == len(self) and k.startswith("n_")}
        return out

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if self._open:
            self._open[-1][1].add(name)
        if name not in self._have:
            self._open.append([0.0, set()])
            began = time.perf_counter()
            self._have[name] = getattr(self, f"_get_{name}")()
            spent = time.perf_counter() - began
            inner, asked = self._open.pop()
            self._seconds[name], self._needs[name] = spent - inner, asked
            if self._open:
                self._open[-1][0] += spent
        return self._have[name]

    def watched(self, rule: "Rule") -> tuple[np.ndarray, float, set[str]]:
        """The rule's mask, its seconds without those of columns, and the columns that it asked for."""
        self._open.append([0.0, set()])
        began = time.perf_counter()
        bad = rule.rejects(self)
        spent = time.perf_counter() - began
        inner, asked = self._open.pop()
        return bad, spent - inner, asked

    def _get_words(self):
        return wh.words(self.data, self.off)

    def _get_n_words(self):
        return self.words.counts

    def _get_n_word_chars(self):
        solid = np.cumsum((~wh.SPACE[self.data] & ((self.data & 0xC0) != 0x80)), dtype=np.int64)
        return np.diff(np.concatenate(([0], solid))[self.off])

    def _get_n_symbols(self):
        return _marks(SYMBOLS[self.data], self.off)

    def _get_n_upper(self):
        return _marks((self.data >= 65) & (self.data <= 90), self.off)

    def _get_n_letters(self):
        low = self.data | 0x20
        return np.diff(np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int64)))[self.off])

    def _get_lines(self):
        """(document, hash) of each \\n-split line that has a word, in order of both."""
        ends = np.union1d(np.flatnonzero(self.data == 10), self.off[1:])
        starts = np.concatenate(([0], ends[:-1] + (self.data[np.minimum(ends[:-1], len(self.data) - 1)] == 10))) if len(self.data) else ends * 0
        starts = np.maximum(starts, 0)
        doc = np.searchsorted(self.off, starts, side="right") - 1
        solid = np.searchsorted(self.words.start, [starts, ends])
        full = (ends > starts) & (solid[1] > solid[0])
        h = wh.span_hashes(self.data, starts[full], ends[full], _KEY)
        order = np.lexsort((h, doc[full]))
        return doc[full][order], h[order]

    def _get_n_lines(self):
        return np.bincount(self.lines[0], minlength=len(self)).astype(np.int64)

    def _get_n_dup_lines(self):
        doc, h = self.lines
        again = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
        return np.bincount(doc[1:][again], minlength=len(self)).astype(np.int64)

    def _get_hashes(self):
        return wh.span_hashes(self.data, self.words.start, self.words.end, _KEY)

    def _get_n_stutters(self):
        """Words equal to the word before them in the same text."""
        h = self.hashes
        same = np.concatenate(([False], h[1:] == h[:-1]))[: len(h)]
        same[self.words.first[:-1][self.words.counts > 0]] = False
        return _marks(same, self.words.first)

    def _get_n_repeat_words(self):
        w = self.words
        at, doc = wh.gram_starts(w.first, 5)
        if not len(at):
            return np.zeros(len(self), np.int64)
        grams = wh.gram_hashes(self.hashes, 5, key=_KEY)[at]
        cover = np.zeros(len(w.start) + 1, np.int64)
        order = np.lexsort((grams, doc))
        same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        return np.diff(inside[w.first])


@dataclass(frozen=True)
class Rule:
    """rejects(texts) gives a mask of the texts that the rule turns away."""

    name: str
    rejects: Callable[[Texts], np.ndarray] = field(compare=False)


def default_rules() -> tuple[Rule, ...]:
    """Length, repetition, symbols, shouting, repeated lines, stutters, word length; the first two are the base verdict."""
    return (
        Rule("few_words", lambda t: t.n_words < 10),
        Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
        Rule("symbols", lambda t: 100 * t.n_symbols > 30 * t.n_words),
        Rule("shouting", lambda t: 100 * t.n_upper > 50 * t.n_letters),
        Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
        Rule("stutter", lambda t: 100 * t.n_stutters > 30 * t.n_words),
        Rule("word_length", lambda t: (t.n_word_chars < 2 * t.n_words) | (t.n_word_chars > 25 * t.n_words)),
    )


def _each_piece(batches, column: int):
    for batch in batches:
        data, off = wh.utf8(batch.column(column))
        for a, b in wh.pieces(off, PIECE, 1 << 20):
            yield batch.slice(a, b - a), Texts(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _all_needs(asked: set[str], needs: dict[str, set[str]]) -> set[str]:
    found, todo = set(), list(asked)
    while todo:
        c = todo.pop()
        if c not in found:
            found.add(c)
            todo += needs.get(c, ())
    return found


def greedy_order(names: list[str], patterns: dict[int, int], own: dict[str, float], columns: dict[str, float], needs: dict[str, set[str]], free: set[str]) -> list[str]:
    """Rules by what they reject of the rest, per second that they add.

    patterns: how many documents are rejected by which rules (bit k: the k-th name); own:
    seconds of each rule without columns; columns: seconds of each column; needs: all
    columns of each rule; free: columns that are computed anyway. Ties keep the given order.
    """
    order, rest, have = [], list(range(len(names))), set(free)
    while rest:
        rate = lambda k: sum(n for p, n in patterns.items() if p >> k & 1) / max(own.get(names[k], 0.0) + sum(columns.get(c, 0.0) for c in needs.get(names[k], set()) - have), 1e-9)  # noqa: B023, E731
        best = max(rest, key=lambda k: (rate(k), -k))
        order.append(names[best])
        rest.remove(best)
        have |= needs.get(names[best], set())
        patterns = {p: n for p, n in patterns.items() if not p >> best & 1}
    return order


def rule_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 2000, seed: int = 1, free: tuple[str, ...] = ()) -> list[str]:
    """Names of the rules by rejection per second, highest first, on a sample of about sample_rows rows.

    The sample decides the order of work alone, never a verdict. With an empty sample the
    given order stays. free: columns that are computed for every text anyway.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(total, 1)), seed)

    def measure(batches):
        for _, texts in _each_piece(batches, 0):
            masks, rows = np.zeros(len(texts), np.int64), []
            for k, rule in enumerate(rules):
                bad, spent, asked = texts.watched(rule)
                masks |= bad.astype(np.int64) << k
                rows += [("rule", rule.name, 0, spent), *(("need", f"{rule.name} {c}", 0, 0.0) for c in _all_needs(asked, texts._needs))]
            rows += [("column", c, 0, s) for c, s in texts._seconds.items()]
            rows += [("pattern", str(p), n, 0.0) for p, n in zip(*(x.tolist() for x in np.unique(masks, return_counts=True)), strict=True)]
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "name", "n", "s"), map(list, zip(*rows, strict=True)), strict=True)))

    # a row per rule, column, need and pattern of rejection
    found = sample.mapInArrow(measure, "kind string, name string, n long, s double").groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    of = lambda kind: {r["name"]: r for r in found if r["kind"] == kind}
    seconds = lambda kind: {k: r["s"] for k, r in of(kind).items()}
    needs = {r.name: {k.split(" ")[1] for k in of("need") if k.split(" ")[0] == r.name} for r in rules}
    columns = seconds("column")
    paid = {c for c in columns if c in free}
    return greedy_order([r.name for r in rules], {int(k): r["n"] for k, r in of("pattern").items()}, seconds("rule"), columns, needs, paid)


_BASE = ("n_words", "n_word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: columns that those are made from
_SHARED = ("words", "hashes", "lines")


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] | None = None, order: list[str] | None = None, counts: bool = False, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The carried columns of docs (with a column text), kept boolean and rejected_by string.

    with_text=True gives the texts that are kept too (null for the others).
    counts=True adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every
    text. A word is `[^\\\\x20\\\\x09-\\\\x0D]+`. Null and empty texts have no words and are rejected
    (few_words). rejected_by names the rule that turned a text away first; with several
    at fault it depends on the order. Repeated rows are judged alike; columns that are not
    carried are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rules = rules or default_rules()
    by_name = {r.name: r for r in rules}
    ranked = [by_name[n] for n in (order or rule_order(docs, rules, free=(*_BASE, *_SHARED) if counts else ()))]
    source = docs.select(*carry, "text")
    fields = [source.schema[c] for c in carry]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kept boolean, rejected_by string"
    extra = _BASE if counts else ()
    ddl += "".join(f", {c.replace('n_word_chars', 'word_chars')} long" for c in extra) + ", text string" * with_text

    def run(batches):
        for batch, texts in _each_piece(batches, len(carry)):
            columns = [np.asarray(getattr(texts, c)) for c in extra]
            alive, by = np.arange(len(texts)), np.full(len(texts), None, dtype=object)
            left = texts
            for rule in ranked:
                if not len(alive):
                    break
                bad = rule.rejects(left)
                by[alive[bad]] = rule.name
                if bad.any():
                    alive, left = alive[~bad], left.take(~bad)
            kept = np.array([x is None for x in by], bool)
            arrays = [batch.column(k) for k in range(len(carry))] + [pa.array(kept), pa.array(by.tolist(), pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)]
            if with_text:
                arrays.append(batch.column(len(carry)).take(pa.array(np.arange(len(kept)), mask=~kept)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "kept", "rejected_by", *(c.replace("n_word_chars", "word_chars") for c in extra), *["text"] * with_text])

    return source.mapInArrow(run, ddl)
