"""Free-entered makers and models mapped to the entries of a catalog.

A multi-pattern automaton over the catalog's makers, series and their aliases finds mentions in the squashed text; the longest non-overlapping
matches win. Tokens that remain go to token-set similarity: each set of neighbouring tokens is compared with the names found by an index of
deletions, and the entry meant must account for every token. Numbers and generations must be equal, since another number or generation is another model.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to which the catalog is broadcast to the workers; a larger one is refused rather than cut.
MAX_ENTRIES, MAX_BYTES = 1_000_000, 200_000_000
REMEMBER, SHORT = 200_000, 256

# Letters that look like Latin ones, in upper and lower case.
LOOK_ALIKE = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјкморстухвн"
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρυ",
    "ABESIJKMHOPCTYXaesijkmopctyxbh"
    "ABEZHIKMNOPTYXaiovpu",
)
# Letters that look like digits, in numbers only.
DIGIT_ALIKE = str.maketrans("oil|", "0111")
# Legal forms and the like that say nothing of the maker.
FORMS = frozenset("inc incorporated corp corporation ltd limited co company gmbh ag kg sa llc plc imaging".split())
_ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "i": 1}
_MARK = ("mark", "mk")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile("[a-z]*")
_NUMBER = re.compile(r"x?\d+")


def plain(s: str) -> str:
    """Compatibility forms, look-alikes and diacritics undone, lower case, no invisible characters."""
    return _plain(s) if len(s) <= SHORT else _plain.__wrapped__(s)


@lru_cache(65536)
def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).translate(LOOK_ALIKE)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\t\n\r")
    return s.replace("ß", "ss").replace("Ø", "O").replace("ø", "o").replace("ł", "l").replace("Ł", "L").casefold()


def words(s: str) -> list[str]:
    """Words and numbers of a plain text: 'umbra40 mk3' -> umbra, 40, mk, 3; a number may carry an x in front."""
    out = []
    for chunk in re.split(r"[^a-z0-9|]+", s):
        if not chunk:
            continue
        # Trailing part of the chunk that reads as a number, with letters that look like digits.
        j = len(chunk)
        while j and chunk[j - 1] in "0123456789oil|":
            j -= 1
        x = "x" if j and chunk[j - 1] == "x" else ""
        head, tail = chunk[: j - len(x)], chunk[j:]
        if any(c.isdigit() for c in tail) and (not head or _LETTERS.fullmatch(head)):
            num = tail.translate(DIGIT_ALIKE)
            # 'zodiaca20': the word ends before the digits; letters that look like digits stay with the word
            cut = next(k for k, c in enumerate(tail) if c.isdigit())
            if cut and head:
                head, num, x = head + x + tail[:cut], tail[cut:].translate(DIGIT_ALIKE), ""
            if head:
                out.append(head)
            out.append(x + num)
        else:
            out += _WORD.findall(chunk)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(65536)
def _form(word: str) -> bool:
    """A legal form, perhaps misspelt."""
    return len(word) > 1 and any(len(f) > 2 and distance(word, f, 1) <= 1 for f in FORMS)


def _near(word: str) -> bool:
    """A legal form of two letters, perhaps misspelt."""
    return len(word) <= 3 and any(len(f) == 2 and distance(word, f, 1) <= 1 for f in FORMS)


def _deletions(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out; words within so many edits share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _edits(word: str) -> int:
    """Edits allowed in a misspelt word: one, or two from eight letters on."""
    return 2 if len(word) >= 8 else 1


class Catalog:
    """A catalog with its automaton. Entries: (id, maker, model); a model is a series, a number and a generation. Aliases: (alias, maker or series)."""

    def __init__(self, entries: list[tuple[int, str, str]], aliases: list[tuple[str, str]] = ()) -> None:
        self.models: dict[tuple[str, str, int], set[tuple[str, int]]] = {}
        self.names: dict[str, dict[str, str]] = {"maker": {}, "series": {}}
        for cid, maker, model in entries:
            if not maker or not model:
                continue
            m = " ".join(words(plain(maker)))
            series, number, generation, rest = self._designation(words(plain(model)))
            if rest or not series:
                series, number, generation = " ".join(words(plain(model))), "", 1
            self.models.setdefault((series, number, generation), set()).add((m, cid))
            self.names["maker"][m.replace(" ", "")] = m
            self.names["series"][series.replace(" ", "")] = series
        known = {kind: dict(names) for kind, names in self.names.items()}
        for alias, name in aliases:
            squashed = "".join(words(plain(name)))
            for kind, names in known.items():
                if squashed in names and plain(alias).strip():
                    self.names[kind]["".join(words(plain(alias)))] = names[squashed]
        self.longest = max((len(n) for names in self.names.values() for n in names), default=0)
        self.index: dict[str, dict[str, set[str]]] = {"maker": {}, "series": {}}
        for kind, names in self.names.items():
            for squashed, name in names.items():
                for part in {squashed, *(w for w in name.split(" ") if len(w) > 3)}:
                    for d in _deletions(part, 2 if len(part) >= 6 else 1):
                        self.index[kind].setdefault(d, set()).add(squashed)
        self.machine = ahocorasick.Automaton()
        both: dict[str, list[tuple[str, str]]] = {}
        for kind, names in self.names.items():
            for squashed, name in names.items():
                for form in ("", *FORMS) if kind == "maker" else ("",):  # with a legal form as an alias
                    both.setdefault(squashed + form, []).append((kind, name))
        for squashed, what in both.items():
            self.machine.add_word(squashed, (len(squashed), what))
        if both:
            self.machine.make_automaton()

    @staticmethod
    def _generation(ws: list[str], i: int) -> tuple[int, int] | None:
        """(generation, words used) at word i: 'mark ii', 'mk 3', 'mkii', 'ii'."""
        w = ws[i]
        if w in _ROMAN and i > 0:
            return _ROMAN[w], 1
        for m in _MARK:
            if w == m or (len(w) == len(m) and len(m) > 2 and distance(w, m, 1) <= 1):
                if i + 1 < len(ws) and (ws[i + 1] in _ROMAN or ws[i + 1].isdigit()):
                    return _ROMAN.get(ws[i + 1]) or int(ws[i + 1]), 2
            elif w.startswith(m) and w[len(m) :] in _ROMAN:
                return _ROMAN[w[len(m) :]], 1
        return None

    def _designation(self, ws: list[str]) -> tuple[str, str, int, list[str]]:
        """(series, number, generation, words that are none of these) of a model's words."""
        for i, w in enumerate(ws):
            if i and _NUMBER.fullmatch(w):
                g = self._generation(ws, i + 1) if i + 1 < len(ws) else None
                rest = ws[i + 1 + (g[1] if g else 0) :]
                return " ".join(ws[:i]), w, g[0] if g else 1, rest
        return "", "", 1, ws

    def _mentions(self, ws: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
        """Longest non-overlapping mentions that begin and end at words, and the words left over."""
        text = "".join(ws)
        start = {}
        end = {}
        at = 0
        for i, w in enumerate(ws):
            start[at] = i
            at += len(w)
            end[at] = i + 1
        hits = [(e + 1 - n, e + 1, what) for e, (n, what) in self.machine.iter(text)] if text and len(self.machine) else []
        hits = sorted((s - e, start[s], end[e], what) for s, e, what in hits if s in start and e in end)  # the longest first
        used = [False] * len(ws)
        found = []
        for _, s, e, what in hits:
            if not any(used[s:e]):
                used[s:e] = [True] * (e - s)
                found.append((s, what))
        return [w for _, what in sorted(found, key=lambda f: f[0]) for w in what[:1]], [w for w, u in zip(ws, used) if not u]

    @lru_cache(REMEMBER)  # noqa: B019
    def _closest(self, tokens: tuple[str, ...], kind: str) -> frozenset[str]:
        """The names most similar to a set of tokens: fewest edits between the squashed words, or between the tokens in any order, each within what ``_edits`` allows."""
        word = "".join(tokens)
        if not 4 <= len(word) <= self.longest + 2:  # no name is within two edits of a longer word
            return frozenset()
        index, names = self.index[kind], self.names[kind]
        near = set().union(*(index.get(d, ()) for t in {word, *tokens} if len(t) > 3 for d in _deletions(t, _edits(t))))
        best, who = _edits(word) + 1, set()
        for squashed in near:
            d = distance(word, squashed, min(_edits(word), best))
            own = names[squashed].split(" ")
            if len(tokens) > 1 and len(own) == len(tokens):
                pairs = [[distance(t, o, _edits(t)) for o in own] for t in tokens]
                for order in permutations(range(len(own))):
                    if all(pairs[i][j] <= _edits(tokens[i]) for i, j in enumerate(order)):
                        d = min(d, sum(pairs[i][j] for i, j in enumerate(order)))
            if d < best:
                best, who = d, {names[squashed]}
            elif d == best and d <= _edits(word):
                who.add(names[squashed])
        return frozenset(who)

    def _resolve(self, ws: list[str]) -> tuple[set[str], set[str], list[tuple[frozenset[str], frozenset[str]]], list[str]] | None:
        """(makers, series, (makers, series) that each set of remaining tokens may be, tokens that must be a misspelt form) of words without numbers."""
        found, left = self._mentions(ws)
        makers = {n for k, n in found if k == "maker"}
        series = {n for k, n in found if k == "series"}
        # 'to ltd': a misspelt form of two letters counts before another form.
        left = [w for w, after in zip(left, [*left[1:], ""]) if w not in FORMS and not (makers and (_form(w) or (_near(w) and (after in FORMS or _form(after)))))]
        i, options, odd = 0, [], []
        while i < len(left):
            for take in (3, 2, 1):
                if i + take <= len(left):
                    m, s = (self._closest(tuple(left[i : i + take]), kind) for kind in ("maker", "series"))
                    if m or s:
                        options.append((m, s))
                        i += take
                        break
            else:
                if not _form(left[i]):
                    return None
                odd.append(left[i])
                i += 1
        return makers, series, options, odd

    def find(self, make: str | None, model: str | None) -> int:
        """The id of the entry meant by the two values, or 0."""
        for order in ((make, model), (model, make)):
            ws = words(plain(" ".join(x for x in order if x)))
            at = [i for i, w in enumerate(ws) if _NUMBER.fullmatch(w) and not (i and ws[i - 1] in _MARK)]
            if len(at) != 1 or at[0] == 0:
                continue
            i = at[0]
            g = self._generation(ws, i + 1) if i + 1 < len(ws) else None
            sides = [self._resolve(ws[:i]), self._resolve(ws[i + 1 + (g[1] if g else 0) :])]
            if None in sides:
                continue
            makers, series, options, odd = (set().union(*x) if k < 2 else sum(x, []) for k, x in enumerate(zip(*sides)))
            ids = self._meant(makers, series, options, ws[i], g[0] if g else 1)
            if len(ids) == 1 and (not odd or makers or len(options) > (not series)):
                return ids.pop()
        return 0

    def _meant(self, makers: set[str], series: set[str], options: list[tuple[frozenset[str], frozenset[str]]], number: str, generation: int) -> set[int]:
        """The entries of this number and generation that account for every name: one series, and at most one maker, its own."""
        if len(series) > 1 or len(makers) > 1:
            return set()
        if series:
            readings = [(series, options)]
        else:
            readings = [(s, options[:k] + options[k + 1 :]) for k, (_, s) in enumerate(options) if s]
        ids = set()
        for names, others in readings:
            sure = not makers and not others and len(names) > 1  # a tie that no maker decides
            for name in () if sure else names:
                ids |= {c for m, c in self.models.get((name, number, generation), ()) if (not makers or m in makers) and all(m in o for o, _ in others)}
        return ids


#: The catalog of this worker, by the call of ``mapped`` that it belongs to.
_BUILT: dict[str, Catalog] = {}


def mapped(rows: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, make, model, catalog_id): the entry meant by each row's make and model, 0 if none is.

    ``rows``: key, make, model; ``catalog``: catalog_id, make, model; ``aliases``: alias, name (another name of a maker or series). Values are read whole. A row without make and model (null, or only blanks and NUL characters) gives no row. A maker
    alone, a model of two makers, and text with words that belong to no name mean no entry. Repeated rows are kept; an
    empty catalog maps everything to 0; other columns are ignored.
    """
    entries = [tuple(r) for r in catalog.select("catalog_id", "make", "model").dropDuplicates().limit(MAX_ENTRIES + 1).collect()]
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"the catalog has more than {MAX_ENTRIES} entries")
    others = [tuple(r) for r in aliases.select("alias", "name").dropna().dropDuplicates().limit(MAX_ENTRIES + 1).collect()] if aliases is not None else []
    if len(others) > MAX_ENTRIES or sum(len(x or "") for e in (*entries, *others) for x in e if not isinstance(x, int)) > MAX_BYTES:
        raise ValueError("the catalog is too large for a broadcast")
    shared, call = rows.sparkSession.sparkContext.broadcast((entries, others)), uuid.uuid4().hex
    blank = lambda c: F.coalesce(F.length(F.regexp_replace(c, r"[\s\p{Z}\x00]+", "")), F.lit(0)) == 0
    src = rows.select("key", "make", "model").where(~(blank(F.col("make")) & blank(F.col("model"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if call not in _BUILT:  # once per worker
            _BUILT.clear()
            _BUILT[call] = Catalog(*shared.value)
        find, known = _BUILT[call].find, {}
        for b in batches:
            out = []
            for p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                v = known.get(p)
                if v is None:
                    v = find(*p)
                    if len(p[0] or "") + len(p[1] or "") <= SHORT:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[p] = v
                out.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["key", "make", "model", "catalog_id"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, make string, model string, catalog_id long")
