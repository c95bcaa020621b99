import unicodedata

from sievework.llm import forms, textnorm

A = "The café sold 12 filters – cheap, in Moscow."
ALIKE = [A, unicodedata.normalize("NFD", A), A.replace(" ", " "), A.replace("fi", "ﬁ"), A.replace("l", "l​"), A.replace("12", "１２"), A.replace("o", "о"), "﻿" + A, A.replace("a", "ɑ"), A.replace("o", "օ").replace("p", "ρ"),
         unicodedata.normalize("NFD", A).replace("é", "е́"), A.replace("w", "𝐰")]
OTHER = [A.upper(), A.replace("é", "e"), A.replace("12", "13"), A.replace("–", "-"), A.replace(",", ""), A.replace("cheap", "cheaper"), A.replace("12", "1²"), A.replace("i", "ı")]
MORE = ["Ещё один тёплый, синий день: почта", unicodedata.normalize("NFD", "Ещё один тёплый, синий день: почта"), "Ещё один тёплый, синии день: почта", "two \U0001f468‍\U0001f469 of them in one picture", "two \U0001f468\U0001f469 of them in one picture",
        "שָׁלוֹם to all who read this", "שלום to all who read this"]
SCHEMA = "doc_id long, text string, forms string, read_h int"


def test_look_alikes_come_from_the_confusables(spark):
    letters = textnorm.look_alikes(spark)
    assert len(letters) > 100 and all(letters[c] == x for c, x in zip("ԁρօναɑАОсі", "dpovaaAOci", strict=True)) and "ı" not in letters and "é" not in letters
    read = {textnorm.read_form(x, letters) for x in ALIKE}
    assert read == {A} and len({textnorm.read_form(x, letters) for x in [A, *OTHER]}) == len(OTHER) + 1
    assert textnorm.read_form("\U0001f468‍\U0001f469 ‍x", letters) == "\U0001f468‍\U0001f469 x" and textnorm.read_form("a\r\nb\tc", letters) == "a\nb c"


def brute(spark, texts, least=20):
    """All pairs by the composed reading form; what the collation alone would merge must differ in it."""
    letters = textnorm.look_alikes(spark)
    r = [textnorm.read_form(t, letters) if t else None for t in texts]
    return {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and min(len(a), len(b)) > least and a != b and r[i] == r[j]}


def test_pairs_against_brute_force(spark):
    texts = ALIKE + OTHER + MORE + [A, None, "", "short", "shоrt", A.replace("o", "о"), "x" * 300_000, "x" * 300_000 + "​"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)] + [(0, A, None, None), (None, A, None, None)], SCHEMA)
    want = brute(spark, texts)
    assert {tuple(r) for r in forms.alike_pairs(df).collect()} == want and len(want) > 60
    # without the collation decomposed letters are strangers to composed ones
    plain = {tuple(r) for r in forms.alike_pairs(df, same="UTF8_BINARY").collect()}
    assert plain < want and (0, 1) in want - plain and (len(ALIKE) + len(OTHER), len(ALIKE) + len(OTHER) + 1) in want - plain


def test_canonical_members(spark):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*ALIKE, *OTHER, None])], SCHEMA)
    got = {r.doc_id: r for r in forms.consistent(df).collect()}
    assert len(got) == len(ALIKE) + len(OTHER) + 1
    assert {got[i].canonical_text for i in range(len(ALIKE))} == {A} and got[0].forms == len(ALIKE) and len({got[i].read_h for i in range(len(ALIKE))}) == 1
    assert all(got[len(ALIKE) + i].canonical_text == t and got[len(ALIKE) + i].forms == 1 for i, t in enumerate(OTHER)) and got[len(ALIKE) + len(OTHER)].canonical_text is None


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert forms.alike_pairs(df).count() == 0 and forms.consistent(df).count() == 0
