from pyspark.sql import functions as F

from sparkloom.functions import names as N

ROWS = [
    # name, headgroup, chains, carbons, dbe, parity, modifications, n
    ("PC 16:0_18:1", "PC", [(16, 0), (18, 1)], 34, 1, "even", "", 0),
    ("PE O-18:1_20:4", "PE O-", [(18, 1), (20, 4)], 38, 5, "even", "", 0),
    ("[D7]PC 15:0_18:1", "PC", [(15, 0), (18, 1)], 33, 1, "odd", "", 0),
    ("Cer 18:1;O2/16:0", "Cer", [(18, 1), (16, 0)], 34, 1, "even", "", 0),
    ("ST 27:2;O (Cholestenone)", "ST", [(27, 2)], 27, 2, "odd", "O (Cholestenone)", 2),
    ("FA 18:2;O3", "FA", [(18, 2)], 18, 2, "even", "O3", 3),
    ("CL 18:1_18:2_16:0_16:1", "CL", [(18, 1), (18, 2), (16, 0), (16, 1)], 68, 4, "even", "", 0),
    ("", "", [], None, None, "", "", 0),
    (None, "", [], None, None, "", "", 0),
]


def test_parsing(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "i int, name string")
    n = F.col("name")
    chains, mods = N.acyls(n), N.modifications(n)
    got = df.select("i", N.headgroup(n), chains, N.total(chains, "carbons"), N.total(chains, "dbe"), N.parity(N.total(chains, "carbons")), mods, N.n_modifications(mods)).collect()
    for i, head, found, *rest in sorted(got):
        assert (head, [tuple(x) for x in found], *rest) == ROWS[i][1:], ROWS[i][0]


def one(spark, expression, **values):
    types = {str: "string", int: "int", float: "double", type(None): "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return df.select(expression).first()[0]


def test_descriptors(spark):
    text = F.col("a")
    for value, want in (("[M+H]+, [M]-", "Pos"), ("[M+2H]2+", "Pos"), ("[M-H]-", "Neg"), ("x", ""), (None, "")):
        assert one(spark, N.polarity(text), a=value) == want
    for value, want in (("[M+HCOO]-; x", "[M+formate]-"), ("nan", ""), ("[M+NH4]+, [2M+NH4]+", "[M+NH4]+"), (None, "")):
        assert one(spark, N.primary_adduct(text), a=value) == want
    for value, want in ((0, "0C"), (10, "1-10C"), (11, "11-16C"), (71, ">70C")):
        assert one(spark, N.carbon_bin(text), a=value) == want
    for value, want in (("O2", False), ("O3 ", False), ("O4", True), ("OH", True), ("", False)):
        assert one(spark, N.is_oxidized(text, F.lit("Cer")), a=value) is want
    assert one(spark, N.is_oxidized(text, F.lit("PC")), a="O2") is True
    for value, want in (("P_S1_P1_x[POS]", "S1"), ("N_abc", "abc"), ("S_NEG", "S")):
        assert one(spark, N.sample_name(text), a=value) == want
    for value, want in (("12,5 %", 12.5), ("<3", 3.0), ("x", None), (None, None)):
        assert one(spark, N.number_in(text), a=value) == want
    assert one(spark, N.motifs(text), a="TG 16:0_16:0_18:1") == ["16:0", "18:1"]
    assert one(spark, N.motifs(text), a="PC 34:1") == []


def test_species(spark):
    cases = [
        ("PC", 34, 1, "", "PC 16:0_18:1", "PC 34:1"), ("PE O-", 36, 2, None, "PE O-36:2", "PE O-36:2"), ("Hex2Cer", 34, 1, "", "Hex2Cer 18:1;O2/16:0", "HexCer 34:1;O2"),
        ("FA", 18, 2, "O3", "FA 18:2;O3", "FA 18:2;O3"), ("X", 0, 0, "", " X ", "X"),
    ]
    for head, c, d, mods, name, want in cases:
        assert one(spark, N.species_label(*map(F.col, "hcdmn")), h=head, c=c, d=d, m=mods, n=name) == want
    for kind, head, name, want in (("PC", "PC", "PC 34:1", False), ("PC", "PC", "PC 16:0_18:1", True), ("TG", "TG", "TG 16:0_34:1", False), ("CL", "CL", "CL 1:0_2:0_3:0_4:0", True), ("FA", "FA", "FA 18:0", True), ("zz", "LNAPE", "x", False), ("zz", "NAPE", "a_b_c", True)):
        level = N.annotation_level(N.n_chains(F.col("k"), F.col("h"), F.col("n")), F.col("n"))
        assert (one(spark, level, k=kind, h=head, n=name) == "Molecular level") is want, name
