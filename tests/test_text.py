"""Case folding of every letter and digit, against the language's own."""

import re

from voxloom.functions.text import seam_key

#: These fold to their capitals; what counts is that both forms have one key.
CHEROKEE = re.compile("[\u13a0-\u13ff\uab70-\uabbf]")


def test_keys_are_case_folded(spark):
    letters = [chr(c) for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000 and re.match(r"\w", chr(c))]
    cased = [c for c in letters if c.casefold() != c or c.upper() != c or c.lower() != c]
    words = [*cased, "ﬁne", "Straße", "STRASSE", "ΣΟΦΟΣ", "İstanbul", "ısı", "ŉa", "it's", "--", ""]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(frame.select("w", seam_key(frame.w)).collect())
    # a letter newer than the JVM's tables is no letter to it
    known = {w: k for w, k in got.items() if k or not re.sub(r"\W", "", w)}
    assert len(got) - len(known) < 100
    wrong = {w: (k, re.sub(r"\W", "", w).casefold()) for w, k in known.items() if k != re.sub(r"\W", "", w).casefold() and not CHEROKEE.match(w)}
    assert not wrong
    assert all(got[c] == got[c.lower()] for c in map(chr, range(0x13A0, 0x13F0)))
    assert len(cased) > 2000 and got["ﬁne"] == "fine" and got["Straße"] == got["STRASSE"]
