"""Texts garbled by reading bytes in the wrong encoding, found and restored.

A code-page swap is a substitution cipher. Which swap garbled a passage is hidden; expectation-maximisation over the swaps of ``codepages``
estimates it from the bigrams of the corpus: each round restores the passages with the present bigrams (E) and counts bigrams and, per source,
swaps anew over the restored passages (M), so that the bigrams of garbled passages fade. The last tables are applied with translate(), or by decoding
where a letter was written in several bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.codepages import NON_ASCII, READ_AS, WIDE, WRITTEN_IN, as_bytes, byte_of, decoded, table
from shutterlake.session import written

ROUNDS = 2
SMOOTH = 0.05
#: Log-likelihood that a restored passage must gain, in all and per changed bigram.
GAIN, GAIN_EACH = 5.0, 1.0
#: The same for a reading as UTF-8, whose validity says much already.
UTF8_GAIN, UTF8_EACH = 1.0, 0.3
#: Log-odds of each kind before any was found: valid UTF-8 is no accident, a passage of few letters fits many code pages.
UTF8_ODDS, ONE_BYTE_ODDS, SAME_TEXT_ODDS = 6.0, -3.0, 4.0
#: What each further swap on top of another must gain more.
AGAIN = 3.0
REMEMBER = 100_000
LOST = "\ufffd"
#: Line ends and tabs count as blanks.
_BLANK = str.maketrans("\n\r\t\v\f", "     ")

_PASSAGE = re.compile(r"(?<=[.!?…])(?=\s)|(?<=[。！？\n\r])")
_SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: The replacement character as each encoding shows its three bytes.
_LOST = re.compile("|".join({LOST, *("".join(c for b in (0xEF, 0xBF, 0xBD) for c, x in byte_of(r).items() if x == b and not 0x80 <= ord(c) < 0xA0) for r in READ_AS)}))
_ONE_BYTE = [(r, w) for r in READ_AS for w in WRITTEN_IN if r != w and w not in WIDE]
_WIDE = [(r, w) for r in READ_AS for w in sorted(WIDE)]


def passages(text: str) -> list[str]:
    """The text cut after sentences and lines; joined they are the text."""
    return [p for p in _PASSAGE.split(text) if p]


def bigrams(s: str) -> list[str]:
    """Pairs of neighbouring characters of which one isn't ASCII; blanks around."""
    s = f" {s} ".translate(_BLANK)
    return [a + b for a, b in zip(s, s[1:]) if a > "\x7f" or b > "\x7f"]


def _keep(held: dict, most: int, key, value):  # noqa: ANN001, ANN202
    """Remember a value; a full memory starts anew."""
    if len(held) >= most:
        held.clear()
    held[key] = value
    return value


class _Bytes(dict):
    """For str.translate: each character as the one of its byte in a page; zero for what the page lacks."""

    def __missing__(self, o: int) -> int:
        return o if o < 128 else 0


@lru_cache(None)
def _to_bytes(read: str) -> _Bytes:
    return _Bytes({o: o for o in range(128)} | {ord(c): b for c, b in byte_of(read).items()})


@lru_cache(None)
def _ends(read: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that show lead bytes and those that show continuation bytes of UTF-8."""
    return tuple(frozenset(c for c, b in byte_of(read).items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))


@lru_cache(1 << 16)
def _utf8_in(s: str, read: str) -> str:
    """``s`` with its valid UTF-8 sequences, as ``read`` shows them, decoded."""
    raw, out, at = s.translate(_to_bytes(read)).encode("latin-1"), [], 0
    for m in _SEQUENCES.finditer(raw):
        try:
            d = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [s[at : m.start()], d]
        at = m.end()
    return "".join([*out, s[at:]]) if at else s


@lru_cache(1 << 15)
def _expansions(w: str) -> tuple[tuple[tuple[str, ...], str], ...]:
    """(chain of pages, reading) of a word, of up to three garblings; a worker keeps them over all rounds."""
    seen, todo, out = {w}, [(w, ())], []
    for _ in range(3):
        more = []
        for s, chain in todo:
            chars = set(s)
            for read in READ_AS:
                lead, more_bytes = _ends(read)
                if not chars.isdisjoint(lead) and not chars.isdisjoint(more_bytes):
                    d = _utf8_in(s, read)
                    if d not in seen:
                        seen.add(d)
                        more.append((d, (*chain, read)))
        out += [(c, d) for d, c in more]
        todo = more
    return tuple(out)


@lru_cache(1 << 15)
def _wide_readings(x: str) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """(reading, swaps of two bytes that give it) of a part between blanks."""
    raws: dict[str, bytes | None] = {}
    out: dict[str, list[int]] = {}
    known: dict[tuple[bytes, str], str | None] = {}
    for k, (read, w) in enumerate(_WIDE):
        if read not in raws:
            raws[read] = as_bytes(x, read)
        raw = raws[read]
        if raw is not None:
            if (raw, w) not in known:  # many pages share their bytes
                known[raw, w] = decoded(x, read, w)
            d = known[raw, w]
            if d is not None and d != x and not d.isascii():
                out.setdefault(d, []).append(k)
    return tuple((d, tuple(k)) for d, k in out.items())


@lru_cache(None)
def _swap_codes() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(no swap's code, character -> its code point under each one-byte swap, -1 where it can't come from the swap)."""
    chars = {o for read, w in _ONE_BYTE for o in table(read, w)}
    return np.full(len(_ONE_BYTE), -1, np.int64), {o: np.array([ord(table(read, w).get(o, "\0")) or -1 for read, w in _ONE_BYTE], np.int64) for o in chars}


def _foreign(s: str) -> int:
    """Letters of scripts other than Latin, from Greek to Hebrew."""
    return sum(1 for c in s if "\u0370" <= c <= "\u05ff")


@dataclass
class Word:
    """What the swaps say of a word between blanks: whether any gains, the most that a one-byte swap gains, the chains of UTF-8 that gain, and the readings in two bytes."""

    live: bool
    most: float
    chains: list[tuple[str, ...]]
    wide: list[tuple[int, str, float]]


class Restorer:
    """Bigram counts and swap counts of a corpus, and what they say of a passage.

    Each reading changes words independently (a blank is no byte of a letter), so what a swap gains is computed once per distinct word and summed over a passage.
    """

    def __init__(self, counts: dict[str, float], swaps: dict[tuple[str, str], float], one_byte: bool = True) -> None:
        total = sum(counts.values()) or 1.0
        self.log = {g: math.log((n + SMOOTH) / total) for g, n in counts.items()}
        self.unseen = math.log(SMOOTH / total)
        pairs = sorted(((ord(g[0]) << 21) | ord(g[1]), v) for g, v in self.log.items()) or [(-1, self.unseen)]
        self.keys, self.logs = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs])
        every = Counter()
        for (_, how), n in swaps.items():
            every[how] += n
        #: Log-odds of a swap: how often it was found in the source, and, for less, anywhere.
        self.swaps = {(src, how): math.log1p(n + every[how] / 10) for (src, how), n in swaps.items()} | {("\n", how): math.log1p(n / 10) for how, n in every.items()}
        self.one_byte = one_byte
        self.known: dict[tuple[str, str, str | None], tuple[str, str | None]] = {}
        self.scores: dict[str, tuple[float, int]] = {}
        self.swapped: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}
        self.words: dict[str, Word] = {}
        self.sums: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}
        self.chained: dict[tuple[str, tuple[str, ...]], tuple[float, int, float, str]] = {}
        self.odds: dict[tuple[str, str | None], np.ndarray] = {}

    def _score(self, around: str) -> tuple[float, int]:
        """(log-probability, bigrams) of a run with the character before and after it."""
        v = self.scores.get(around)
        if v is None:
            get, u, flat = self.log.get, self.unseen, around.translate(_BLANK)
            pairs = [a + b for a, b in zip(flat, flat[1:]) if a > "\x7f" or b > "\x7f"]
            v = _keep(self.scores, 4 * REMEMBER, around, (sum(get(g, u) for g in pairs), len(pairs)))
        return v

    def _chain(self, w: str, chain: tuple[str, ...]) -> tuple[float, int, float, str]:
        """``_reading`` of a word whose bytes are read as UTF-8 once per page of the chain."""
        v = self.chained.get((w, chain))
        if v is None:
            c = w
            for read in chain:
                c = _utf8_in(c, read)
            v = _keep(self.chained, REMEMBER, (w, chain), self._reading(w, c))
        return v

    def _reading(self, w: str, c: str) -> tuple[float, int, float, str]:
        """(gain per bigram times bigrams, bigrams, log-likelihood gained, reading) of a word read as ``c``.

        Runs get shorter by reading several bytes as one letter; whether to accept a reading is judged by means, weighted by the length restored, and which
        of two readings is better by the whole likelihood. Only the runs that gain are taken, since the others may be fine as they are.
        """
        gain, n, total, out, at = 0.0, 0, 0.0, [], 1
        p, c = f" {w} ", f" {c} "
        for a, b in zip(NON_ASCII.finditer(p), NON_ASCII.finditer(c)):
            x, y = a[0], b[0]
            if x == y:
                continue
            so, no = self._score(p[a.start() - 1 : a.end() + 1])
            sc, nc = self._score(c[b.start() - 1 : b.end() + 1])
            # Accidental validity gets unlikely with each byte beyond two.
            own = nc * (sc / nc - so / no) + 2.0 * (sum(2 if o > 0xFFFF else 1 for o in map(ord, y) if o > 0x7FF) if max(y) > "\u07ff" else 0)
            if own > 0:
                gain, n, total = gain + own, n + nc, total + sc - so
                out += [p[at : a.start()], y]
                at = a.end()
        return (gain, n, total, "".join([*out, p[at:-1]])) if n else (0.0, 0, 0.0, w)

    def _chains(self, w: str) -> list[tuple[str, ...]]:
        """The chains of pages, of up to three garblings, under which some run of a word gains."""
        out = []
        for chain, d in _expansions(w):
            v = self._reading(w, d)
            if v[1]:
                out.append(chain)
                _keep(self.chained, REMEMBER, (w, chain), v)
        return out

    def _word(self, w: str) -> Word:
        v = self.words.get(w)
        if v is None:
            most, wide, chains = 0.0, [], self._chains(w)
            if self.one_byte:
                rows = [self._swapped(g) for g in bigrams(w)]
                most = 0.0 if None in rows else max(0.0, float(sum(x for x, _ in rows).max()))
                wide = self._wide_gains(w)
            v = _keep(self.words, REMEMBER, w, Word(bool(most or chains or wide), most, chains, wide))
        return v

    def _swapped(self, g: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(log-likelihood gained, whether it changes) of a bigram under each one-byte swap, -inf where it can't come from the swap; None if from none."""
        if g not in self.swapped:
            none, codes = _swap_codes()
            a, b = (np.full(len(none), ord(c)) if c < "\x80" else codes.get(ord(c), none) for c in g)
            good = (a >= 0) & (b >= 0)
            v = None
            if good.any():
                now, key = self.log.get(g, self.unseen), (a << 21) | b
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                new = np.where(self.keys[at] == key, self.logs[at], self.unseen)
                v = np.where(good, new - now, -math.inf), (a != ord(g[0])) | (b != ord(g[1]))
            _keep(self.swapped, REMEMBER // 10, g, v)
        return self.swapped[g]

    def _sums(self, w: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(log-likelihood gained, bigrams of the runs that change) of a word under each one-byte swap; None if it can come from none."""
        if w not in self.sums:
            gain, n, p = np.zeros(len(_ONE_BYTE)), np.zeros(len(_ONE_BYTE)), f" {w} ".translate(_BLANK)
            for m in NON_ASCII.finditer(p):
                around = p[m.start() - 1 : m.end() + 1]
                rows = [self._swapped(a + b) for a, b in zip(around, around[1:])]
                if None in rows:
                    gain = None
                    break
                gain += sum(x for x, _ in rows)
                n += len(rows) * np.any([y for _, y in rows], axis=0)
            _keep(self.sums, REMEMBER // 20, w, None if gain is None else (gain, n))
        return self.sums[w]

    def _odds(self, source: str, favoured: str | None) -> np.ndarray:
        """The log-odds of each one-byte swap."""
        v = self.odds.get((source, favoured))
        if v is None:
            v = _keep(self.odds, REMEMBER // 100, (source, favoured), np.array([self._prior(source, f"{w}>{read}", favoured) + ONE_BYTE_ODDS for read, w in _ONE_BYTE]))
        return v

    def _prior(self, source: str, how: str, favoured: str | None) -> float:
        return self.swaps.get((source, how), self.swaps.get(("\n", how), 0.0)) + (SAME_TEXT_ODDS if how == favoured else 0.0)

    def _wide_gains(self, x: str) -> list[tuple[int, str, float]]:
        """(swap of two bytes, reading, log-likelihood gained) of a part between blanks, of those that gain enough."""
        v = []
        readings = _wide_readings(x)
        so, no = self._score(f" {x} ") if readings else (0.0, 1)
        for d, swaps in readings:
            sc, nc = self._score(f" {d} ")
            own = nc * (sc / nc - so / no)
            if own > GAIN and own > GAIN_EACH * nc:
                v += [(k, d, sc - so) for k in swaps]
        return sorted(v)

    def _once(self, p: str, source: str, favoured: str | None) -> tuple[str, str | None]:
        """The best reading of a passage under one swap, and the swap; None if none is better than the passage as it is."""
        parts = p.split(" ")
        at, known, most, chains, wide = {}, self.words.get, 0.0, False, False
        for i, w in enumerate(parts):
            if not w.isascii():
                v = at[i] = known(w) or self._word(w)
                if v.live:
                    most += v.most
                    chains = chains or v.chains
                    wide = wide or v.wide
        # The sum of the most that each word gains bounds what any one swap gains.
        if not chains and not wide and most < GAIN_EACH:
            return p, None
        best, found, how = 0.0, p, None
        hot = [i for i, w in at.items() if w.chains] if chains else []  # the others gain under no chain
        for chain in sorted({c for i in hot for c in at[i].chains}, key=lambda c: (len(c), c)):
            read, gain, n, total = {}, 0.0, 0, 0.0
            for i in hot:
                g, k, t, read[i] = self._chain(parts[i], chain)
                gain, n, total = gain + g, n + k, total + t
            name = ">".join(("utf_8", *chain))
            odds = self._prior(source, name, favoured) - AGAIN * (len(chain) - 1) + UTF8_ODDS
            if n and gain >= UTF8_EACH * n and gain >= UTF8_GAIN and total + odds > best:
                best, how = total + odds, name
                found = " ".join(read.get(i, w) for i, w in enumerate(parts))
        if not self.one_byte:
            return found, how
        if most >= GAIN_EACH:
            rows = [self._sums(parts[i]) for i in at]
            if None not in rows:
                gain, n = sum(x for x, _ in rows), sum(y for _, y in rows)
                score = np.where((n > 0) & (gain >= GAIN_EACH * n), gain + self._odds(source, favoured), -math.inf)
                strange = None
                for k in np.argsort(-score, kind="stable"):
                    if score[k] < GAIN or score[k] <= best:
                        break
                    read, w = _ONE_BYTE[k]
                    d = p.translate(table(read, w))
                    if strange is None:
                        letters = sum(1 for c in p if c < "\x80" and c.isalpha())
                        strange = 2 * _foreign(p) < letters
                    if not (strange and 0 < 2 * _foreign(d) < letters):
                        best, found, how = float(score[k]), d, f"{w}>{read}"
                        break
        return (self._wide(p, parts, at, best) if wide else None) or (found, how)

    def _wide(self, p: str, parts: list[str], at: dict[int, Word], best: float) -> tuple[str, str] | None:
        """The best reading of parts between blanks as written in an encoding of two bytes, if it gains more than ``best``."""
        if len({c for c in p if c > "\x7f"}) < 4:
            return None
        out, gains, new = None, [0.0] * len(_WIDE), {}
        for i, w in at.items():
            for k, d, gain in w.wide:
                gains[k] += gain
                new.setdefault(k, {})[i] = d
        for k in sorted(new):
            if gains[k] > best:
                read, w = _WIDE[k]
                best = gains[k]
                out = " ".join(new[k].get(i, x) for i, x in enumerate(parts)), f"{w}>{read}"
        return out

    def passage(self, p: str, source: str, favoured: str | None = None) -> tuple[str, str | None]:
        """(restored, swap or None) of one passage; ``favoured`` is the swap of most other passages of its text."""
        if p.isascii():
            return p, None
        key = (p, source, favoured)
        if key in self.known:
            return self.known[key]
        lead = len(p) - len(p.lstrip(" \t\r\n"))
        body = p[lead:].rstrip(" \t\r\n")
        s, how = body, None
        for _ in range(3):  # a passage may be garbled in parts, in several ways
            s2, k = self._once(s, source, favoured)
            if k is None:
                break
            s, how = s2, how or k
        out = p[:lead] + s + p[lead + len(body) :], how
        return _keep(self.known, REMEMBER, key, out)

    def text(self, t: str, source: str) -> tuple[str, bool]:
        """(restored text, whether any of it was garbled). A text is read twice: the swap of most of its passages is likelier for the others."""
        if t.isascii():
            return t, False
        parts = passages(t)
        out = [self.passage(p, source) for p in parts]
        swaps = Counter(how for _, how in out if how)
        if not swaps:
            return t, False
        favoured = min(swaps, key=lambda k: (-swaps[k], k))
        out = [self.passage(p, source, favoured) for p in parts]
        return "".join(s for s, _ in out), any(how for _, how in out)


def _source(c: str) -> F.Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit("")).alias("source")


def learn(docs: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """(bigram counts, swap counts per source) by expectation-maximisation over all passages of ``docs`` (text, source)."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                x = b.slice(s, 2000)
                c = Counter((p.strip(" \t\r\n"), src) for t, src in zip(x.column(0).to_pylist(), x.column(1).to_pylist()) if t and not t.isascii() for p in passages(t) if not p.isascii())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["passage", "source", "n"])

    parts = docs.select("text", _source("source")).mapInArrow(cut, "passage string, source string, n long")
    parts = written(parts.groupBy("passage", "source").agg(F.sum("n").alias("n")), "passages")
    counts: dict[str, float] = {}
    swaps: dict[tuple[str, str], float] = {}
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((counts, swaps))  # bounded by the alphabets' pairs, not by the documents

        def step(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            r = Restorer(*shared.value) if k else None
            words, used = Counter(), Counter()
            for b in batches:
                for p, src, n in zip(*(c.to_pylist() for c in b.columns)):
                    s, how = r.passage(p, src) if r else (p, None)
                    if how:
                        used[src, how] += n
                    for w in s.split(" "):
                        if not w.isascii():
                            words[w] += n
            grams = Counter()
            for w, n in words.items():
                for g in bigrams(w):
                    grams[g] += n
            kind = pa.array([""] * len(grams) + [s for s, _ in used], pa.string())
            key = pa.array([*grams, *(f"\n{h}" for _, h in used)], pa.string())
            yield pa.RecordBatch.from_arrays([kind, key, pa.array([*grams.values(), *used.values()], pa.int64())], names=["source", "key", "n"])

        rows = parts.mapInArrow(step, "source string, key string, n long").groupBy("source", "key").agg(F.sum("n").alias("n")).collect()
        counts = {r.key: float(r.n) for r in rows if r.key[0] != "\n"}
        swaps = {(r.source, r.key[1:]): float(r.n) for r in rows if r.key[0] == "\n"}
    return counts, swaps


def repaired(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, restored, restored_md5) of each affected document; restored is null and restored_md5 '' where any part is lost.

    ``docs``: doc_id, text, source. Lost is what only replacement characters stand for, or control characters that no swap explains. Null and empty texts are unaffected; texts are read whole;
    repeated rows count once, so one row per doc_id (the smallest restored text, if they differ). Null sources are one source. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(*model.value)
        for b in batches:
            ids, out = [], []
            for i, t, src in zip(*(c.to_pylist() for c in b.columns)):
                if not t or t.isascii():
                    continue
                s, hit = r.text(t, src)
                lost = _LOST.search(s) is not None or (hit and _C1.search(s) is not None)
                if hit or lost:
                    ids.append(i)
                    out.append(None if lost else s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "restored"])

    found = docs.select(F.col("doc_id").cast("long"), "text", _source("source")).mapInArrow(run, "doc_id long, restored string")
    found = found.groupBy("doc_id").agg(F.min("restored").alias("restored"))
    return found.withColumn("restored_md5", F.coalesce(F.md5(F.col("restored").cast("binary")), F.lit("")))
