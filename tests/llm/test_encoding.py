"""Garbled text: every swap is tried, whatever the frequency of its letters."""

from __future__ import annotations

from collections import Counter

import pytest

from shutterlake.llm import encoding


def test_a_swap_is_found_though_its_rarest_bigram_stays_unseen() -> None:
    known = ["Über die Brücke führt kein Weg für böse Männer.", "Die Bürger müssen früh über den Fluß zurück."]
    r = encoding.Restorer(Counter(g for s in known * 50 for g in encoding.bigrams(s)), {})
    true = "Özgür führt die Männer früh über die Brücke zurück."  # no known text has " Ö", "Öz" or "gü"
    garbled = true.encode("cp1252").decode("cp437")
    assert r.passage(garbled, "")[0] == true


def test_a_frequent_garbling_is_searched() -> None:
    """However often a garbled letter occurs, what its swap gains decides."""
    known = ["Über die Brücke führt kein Weg für böse Männer.", "Die Bürger müssen früh über den Fluß zurück."]
    garbled = [s.encode("cp1252").decode("cp437") for s in known]
    r = encoding.Restorer(Counter(g for s in known * 900 + garbled * 30 for g in encoding.bigrams(s)), {})
    assert [r.passage(g, "")[0] for g in garbled] == known


def test_every_swap_that_gains_is_scored() -> None:
    """The gains by bigrams are those of the whole passages."""
    known = ["Über die Brücke führt kein Weg für böse Männer.", "Старый мост через реку.", "Une fête d'été à la campagne."]
    r = encoding.Restorer(Counter(g for s in known * 9 for g in encoding.bigrams(s)), {})
    for s in known:
        for read, w in [("cp437", "cp1252"), ("koi8_r", "cp1251"), ("mac_roman", "latin_1"), ("cp1251", "cp866")]:
            try:
                p = s.encode(w).decode(read)
            except UnicodeError:
                continue
            whole = encoding.bigrams(p)
            sums = [r._sums(x) for x in p.split(" ") if not x.isascii()]
            for k, (a, b) in enumerate(encoding._ONE_BYTE):
                d = encoding.decoded(p, a, b)
                gain = sum(r.log.get(y, r.unseen) - r.log.get(x, r.unseen) for x, y in zip(whole, encoding.bigrams(d))) if d is not None and len(encoding.bigrams(d)) == len(whole) else None
                if gain is not None and gain > 1:
                    assert None not in sums
                    assert sum(x[k] for x, _ in sums) == pytest.approx(gain)



@pytest.mark.parametrize("read", ["cp1250", "cp866", "koi8_r", "iso8859_5", "cp850"])
@pytest.mark.parametrize("written", ["shift_jis", "gbk"])
def test_wide_encodings_are_tried_from_every_page(read: str, written: str) -> None:
    true = "写真は山の上で見た人" if written == "shift_jis" else "照片是在山上看到的人"
    chars = []
    for c in true:  # characters whose bytes the page shows
        try:
            shown = c.encode(written).decode(read)
        except UnicodeError:
            continue
        if " " not in shown and encoding.decoded(shown, read, written) == c:
            chars.append(c)
    true = "".join(chars)
    assert len(true) >= 4
    r = encoding.Restorer(Counter(g for s in [true] * 200 for g in encoding.bigrams(s)), {})
    assert r.passage(true.encode(written).decode(read), "")[0] == true
