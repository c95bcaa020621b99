from sievework.llm import encoding

SCHEMA = "candidate_id string, original_name string, corrected_name string, name string, k int"
GOOD = ["Señal Ibérica Tolano", "Łącze Światłowód Bireka", "Canaã São", "Café®", "Лилоби Зефрино ТВ", "Plain Name", "Ð-Line Murado", "Kølig Børn Sateli", "CANAÃ®"]


def bad(text, write, read):
    return text.encode(write).decode(read)


def records():
    pairs = [
        (bad("Señal Ibérica Tolano", "utf-8", "cp1252"), "Señal Ibérica Tolano"), (bad("Łącze Światłowód Bireka", "utf-8", "cp437"), "Łącze Światłowód Bireka"),
        (bad("Kølig Børn Sateli", "utf-8", "mac_roman"), "Kølig Børn Sateli"), (bad("Лилоби Зефрино ТВ", "cp1251", "cp1252"), "Лилоби Зефрино ТВ"), ("K�lig B�rn Mudova", "K�lig B�rn Mudova"),
        (bad(bad("Señal Vorune", "utf-8", "cp1252"), "utf-8", "cp1252"), "x"), ("Se&#195;&#177;al Kareno", "y"), (bad("Señal Mixto", "utf-8", "cp1252").lower(), "z"),
    ]
    out = [(f"c{i}", a, b, None, None) for i, (a, b) in enumerate(pairs)]
    out += [(f"g{i}", g, g, None, None) for i, g in enumerate(GOOD)] + [("n", None, "", None, None), ("g0", GOOD[0], GOOD[0], None, None), (None, "Niño", None, None, None)]
    return out + [("w", "canaã", "Canaã", None, None)]


def test_found_and_repaired(spark):
    df = spark.createDataFrame(records(), SCHEMA)
    got = {(r.candidate_id, r.field_name): r for r in encoding.repaired(df).collect()}
    want = {(f"c{i}", "original_name") for i in range(8)} | {("c4", "corrected_name")}
    assert set(got) == want == {tuple(r) for r in encoding.found(df).collect()}
    fixed = {k[0]: r.repaired for k, r in got.items()}
    assert fixed["c0"] == "Señal Ibérica Tolano" and fixed["c1"] == "Łącze Światłowód Bireka" and fixed["c2"] == "Kølig Børn Sateli" and fixed["c3"] == "Лилоби Зефрино ТВ"
    assert fixed["c4"] == "Kølig Børn Mudova" and fixed["c5"] == "Señal Vorune" and fixed["c6"] == "Señal Kareno" and fixed["c7"] == "señal mixto"


def test_round_trip_of_every_reader():
    text = "Łącze „Été” ñ"
    for r in encoding.READERS:
        raw = text.encode("utf-8")
        table = {b: ch for ch, b in encoding._table(r).items()}
        garbled = "".join(table.get(b, "?") for b in raw)
        if "?" in garbled:
            continue
        runs = encoding.RUN.findall(garbled)
        assert [encoding.undone(x, f"utf-8>{r}", False) for x in runs] == encoding.RUN.findall(text), r


def test_empty_table_and_one_without_twins(spark):
    assert encoding.found(spark.createDataFrame([], SCHEMA)).count() == 0
    assert encoding.found(spark.createDataFrame([("a", "Plain", "Plain", None, None)], SCHEMA)).count() == 0


def test_scripts_and_long_runs_of_one_case():
    for text in ("Việt Nam", "東京タワー", "שלום", "Ñandú", "привет мир", "Γειά σου"):
        raw, table = text.encode(), {b: c for c, b in encoding._table("cp1252").items()}
        for depth in (1, 2):
            garbled = "".join(table[b] for b in raw)
            runs = encoding.RUN.findall(garbled)
            assert [encoding.undone(r, "utf-8>cp1252", False) for r in runs] == encoding.RUN.findall(text), (text, depth)
            raw = garbled.encode()
    # put in one case after it was garbled, twelve cased characters and more
    garbled = "".join({b: c for c, b in encoding._table("cp1252").items()}[b] for b in "приветствие".encode())
    assert encoding.undone(garbled.lower(), "utf-8>cp1252", True) == "приветствие" and sum(c != c.swapcase() for c in garbled) > encoding.CASED
    # good names stay
    for good in ("ВИПЕДА ТВ", "тв®", "TÉLÉ’PLUS", "Été", "Ça été Šč", "東京", "Größe"):
        for chain in encoding.HYPOTHESES:
            one = good in (good.lower(), good.upper())
            if chain.startswith("utf-8>"):
                got = [encoding.undone(r, chain, one) for r in encoding.RUN.findall(good)]
                assert not any(g and len(g) > 1 for g in got), (good, chain, got)


def test_words_that_change_their_script():
    for text, writer in (("Αθήνα δρόμος", "cp1253"), ("привет мир", "cp1251"), ("שלום עולם", "cp1255"), ("ТВЦ", "cp1251")):
        garbled = text.encode(writer).decode("cp1252")
        assert encoding.swapped(garbled, [f"{writer}>cp1252"])[0] == text and f"{writer}>cp1252" in encoding.explain(garbled, text)
    assert encoding.swapped("Αθήνα".encode("cp1253").decode("cp1252"), encoding.HYPOTHESES) == ("Αθήνα", "cp1253>cp1252")
    assert encoding.swapped("Ça été Šč", encoding.HYPOTHESES) is None


def test_runs_that_no_encoding_explains_are_learned(spark):
    """Two twins teach what a third name without a twin means; one twin teaches nothing."""
    rows = [("a", "Se¤¶al Murado", "Señal Murado", None, None), ("b", "Se¤¶al Vorune", "Señal Vorune", None, None), ("c", "Ni¤¶o Kareno", "Ni¤¶o Kareno", None, None), ("d", "Mu§¶eca", "Muñeca", None, None), ("e", "Pi§¶a", "Pi§¶a", None, None)]
    got = {(r.candidate_id, r.field_name): (r.repaired, r.chain) for r in encoding.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "original_name"): ("Señal Murado", "run"), ("b", "original_name"): ("Señal Vorune", "run"), ("c", "original_name"): ("Niño Kareno", "run"), ("c", "corrected_name"): ("Niño Kareno", "run")}
