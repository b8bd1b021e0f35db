"""Lipid names as columns: what a name says about headgroup, chains, modifications and oxidation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHAIN = r"(\d+):(\d+)"

# Names that are replaced as a whole, sphingolipid classes whose O2 and O3 are no oxidation, carbon bins.
REPLACED_NAMES = {"cholestenone": "ST 27:2;O (Cholestenone)", "Cholestenone": "ST 27:2;O (Cholestenone)"}
HYDROXYLATED_CLASSES = ("HexCer", "LacCer", "GlcCer", "GalCer", "SM", "Cer", "ACer")
CARBON_BINS = ((0, 0), (1, 10), (11, 16), (17, 22), (23, 28), (29, 34), (35, 40), (41, 46), (47, 52), (53, 58), (59, 64), (65, 70), (71, 999))


def tidy(name: Column) -> Column:
    """Whole-name replacements, -SN1 and -SN2 stripped, trimmed."""
    out = F.trim(name)
    for old, new in REPLACED_NAMES.items():
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return F.trim(F.regexp_replace(out, r"-SN[12]", ""))


def is_ether(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\bO-"), F.lit(False))


def headgroup(name: Column) -> Column:
    """The first word without a deuterium tag, with ` O-` for ethers; empty for a null name."""
    first = F.regexp_replace(F.substring_index(F.trim(F.coalesce(name, F.lit(""))), " ", 1), r"\[D\d+\]", "")
    return F.when(is_ether(name), F.concat(first, F.lit(" O-"))).otherwise(first)


def polarity(adducts: Column) -> Column:
    """Pos or Neg by the first adduct's charge, else empty."""
    first = F.trim(F.substring_index(F.coalesce(adducts, F.lit("")), ",", 1))
    return F.when(first.rlike(r"\]2?\+"), F.lit("Pos")).when(first.rlike(r"\]2?-"), F.lit("Neg")).otherwise(F.lit(""))


def acyls(name: Column) -> Column:
    """All carbons:double-bonds pairs as array<struct<carbons,dbe>>; empty for a null name."""
    text = F.coalesce(name, F.lit(""))
    c, d = (F.transform(F.regexp_extract_all(text, F.lit(_CHAIN), F.lit(k)), lambda x: x.cast("int")) for k in (1, 2))
    return F.zip_with(c, d, lambda a, b: F.struct(a.alias("carbons"), b.alias("dbe")))


def total(chains: Column, field: str) -> Column:
    """The sum over chains, null without chains."""
    return F.when(F.size(chains) > 0, F.aggregate(chains, F.lit(0), lambda s, x: s + x[field]))


def parity(*counts: Column) -> Column:
    """P5: odd if any count is odd, even if all are even, empty if there is none."""
    known = F.filter(F.array(*counts), lambda x: x.isNotNull())
    return F.when(F.size(known) == 0, F.lit("")).when(F.exists(known, lambda x: x % 2 == 1), F.lit("odd")).otherwise(F.lit("even"))


def is_polyunsaturated(dbe: Column) -> Column:
    """P6."""
    return F.coalesce(dbe >= 2, F.lit(False))


def modifications(name: Column) -> Column:
    """What follows the first ; unless it holds a /, else empty."""
    text = F.coalesce(name, F.lit(""))
    rest = F.when(F.instr(text, ";") > 0, F.regexp_extract(text, r"(?s)^[^;]*;(.*)$", 1)).otherwise(F.lit(""))
    return F.when(F.instr(rest, "/") > 0, F.lit("")).otherwise(F.trim(rest))


def n_modifications(mods: Column) -> Column:
    """The multiplicities of the modifications' tokens, the trailing number before the leading one, 1 without any."""
    token = F.lit(r"(\d*)([A-Za-z]+)(\d*)")
    before, after = (F.regexp_extract_all(mods, token, F.lit(k)) for k in (1, 3))
    count = F.zip_with(before, after, lambda a, b: F.coalesce(F.when(b != "", b.cast("int")), F.when(a != "", a.cast("int")), F.lit(1)))
    return F.aggregate(count, F.lit(0), lambda s, x: s + x)


def is_oxidized(mods: Column, lipid_class: Column) -> Column:
    """An oxygen, hydroxy, hydroperoxy or oxo modification; a sphingolipid's O2 or O3 alone is none."""
    text = F.upper(F.coalesce(mods, F.lit("")))
    exempt = F.coalesce(lipid_class.isin(*HYDROXYLATED_CLASSES), F.lit(False)) & F.trim(text).isin("O2", "O3")
    return ~exempt & ~text.contains("/") & text.rlike(r"\bO\d*\b|OH|OXO")


def carbon_ratio(carbons: Column, dbe: Column) -> Column:
    """Carbons for each double bond; null without double bonds."""
    return carbons / F.nullif(dbe, F.lit(0))


def annotation_type(name: Column, msms_score: Column, source: Column) -> Column:
    """P10: internal standard, MS/MS match, target list, else empty."""
    return (
        F.when(name.rlike(r"\[D\d+\]"), F.lit("IS")).when(msms_score > 0, F.lit("MS/MS match"))
        .when(F.coalesce(F.upper(source).contains("TARGET"), F.lit(False)), F.lit("Target List match (MS, RT, CCS)")).otherwise(F.lit(""))
    )


def annotation_tier(status: Column, msms_score: Column) -> Column:
    """High for target lists and MS/MS scores over 400, low for scores over 1 and for libraries."""
    text = F.coalesce(status, F.lit(""))
    return (
        F.when(text.rlike("Target [Ll]ist|TargetList"), F.lit("High confidence")).when(msms_score > 400, F.lit("High confidence"))
        .when(msms_score > 1, F.lit("Low confidence")).when(text.rlike("Lipid Species|Spectral ?Library"), F.lit("Low confidence")).otherwise(F.lit(""))
    )


# Words for no adduct, and spellings of adducts.
NO_ADDUCT = ("", "nan", "na", "none", "<na>", "null")
ADDUCT_ALIASES = {
    "formate": "[M+formate]-", "[m+formate]-": "[M+formate]-", "[m+hcoo]-": "[M+formate]-", "hcooh-h": "[M+formate]-", "hcoo-h": "[M+formate]-",
    "m+h-h2o": "[M+H-H2O]-", "m-h2o+h": "[M+H-H2O]-",
}


def normal_adduct(adduct: Column) -> Column:
    """An adduct in its usual spelling; empty for words that mean none."""
    plain = F.trim(F.coalesce(adduct, F.lit("")))
    out = F.when(F.lower(plain).isin(*NO_ADDUCT), F.lit("")).otherwise(plain)
    for alias, name in ADDUCT_ALIASES.items():
        out = F.when(F.lower(plain) == alias, F.lit(name)).otherwise(out)
    return out


def primary_adduct(adducts: Column) -> Column:
    """The first of a , or ; list."""
    return normal_adduct(F.regexp_extract(F.coalesce(adducts, F.lit("")), r"^([^,;]*)", 1))


def carbon_bin(carbons: Column) -> Column:
    """One of 13 closed bins; a null is in the first."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(CARBON_BINS):
        name = f"{lo}C" if lo == hi else ">70C" if hi == 999 else f"{lo}-{hi}C"
        out = F.when(F.coalesce(carbons, F.lit(0)).between(lo, hi), F.lit(name)).otherwise(out)
    return out


def kendrick_mass(mass: Column) -> Column:
    return mass * F.lit(14.0) / F.lit(14.01565)


def kendrick_defect(mass: Column) -> Column:
    """Half-even, so within +-0.5."""
    km = kendrick_mass(mass)
    return km - F.rint(km)


def species_label(head: Column, carbons: Column, dbe: Column, mods: Column, name: Column) -> Column:
    """Headgroup, total carbons and double bonds, modifications; the name itself where chains are unknown.

    Variants of HexCer are one; ;O and a number stays for Cer, SM, HexCer and GM where the name tells the chains apart.
    """
    text, group = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(head, F.lit("")))
    group = F.when(group.rlike(r"(?i)(?<![A-Za-z])(?:HexCer|Hex\(\d+\)Cer|Hex\d+Cer|Hex\([2-6]\)-)"), F.lit("HexCer")).otherwise(group)
    gap = F.when(group.contains("O-"), F.lit("")).otherwise(F.lit(" "))
    oxygen = F.when(group.rlike("(?i)^(Cer|SM|HexCer|GM)$") & text.rlike("[/_]"), F.regexp_extract(text, r"(;O\d+)", 1)).otherwise(F.lit(""))
    plain = F.trim(F.coalesce(mods, F.lit("")))
    tail = F.when(F.lower(plain).isin("", "nan", "none", "<na>", "na", "null"), F.lit("")).otherwise(F.concat(F.lit(";"), plain))
    built = F.concat(group, gap, carbons.cast("string"), F.lit(":"), dbe.cast("string"), oxygen, tail)
    return F.when((carbons > 0) & (group != "") & dbe.isNotNull(), built).otherwise(text)


# Fatty-acyl chains of a class, by number.
ONE_CHAIN = (
    "FA", "FOH", "FAG", "FAL", "HC", "CAR", "CoA", "NA", "NAE", "NAT", "MG", "MGMG", "MGDG", "LPC", "LPE", "LPI", "LPS", "LPG", "LPA", "LSM", "LPT", "CE", "ST", "Other",
    "PK", "PR", "SL", "SPB", "SPBP", "SulfateHexSPB",
)
TWO_CHAINS = (
    "WE", "Cer", "CerP", "GlcCer", "HexCer", "Hex2Cer", "SM", "HexSBP", "PE-Cer", "PI-Cer", "SCer", "SHexCer", "M(IP)2C", "MIPC", "PC", "PE", "PI", "PS", "PG", "PA", "BMP",
    "Glc-GP", "GP", "PIM", "PIP", "PnC", "PnE", "PPA", "PT", "DG", "CDP-DG", "DGCC", "DGDG", "DGMG", "DGTA", "DGTS", "GlcADG", "SQDG", "SQMG", "FAHFA",
)
THREE_CHAINS, FOUR_CHAINS = ("TG", "NAPE", "ACer"), ("CL",)


def n_chains(lipid_class: Column, head: Column, name: Column) -> Column:
    """Fatty-acyl chains by class, else by headgroup, else one more than the name has separators (2 to 4)."""
    out = F.lit(None).cast("int")
    for key in (F.trim(head), F.trim(lipid_class)):
        found = F.lit(None).cast("int")
        for n, names in enumerate((ONE_CHAIN, TWO_CHAINS, THREE_CHAINS, FOUR_CHAINS), 1):
            found = F.when(key.isin(*names), F.lit(n)).otherwise(found)
        out = F.coalesce(found, out)
    group = F.upper(F.trim(head))
    nape = F.when(group.rlike("^L.*NAPE$"), F.lit(2)).when(group.endswith("NAPE"), F.lit(3))
    return F.coalesce(out, nape, F.least(F.lit(4), F.greatest(F.lit(2), n_separators(name) + 1)))


def n_separators(name: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^/_]", ""))


def annotation_level(chains: Column, name: Column) -> Column:
    """Molecular if the name tells all chains apart, or there is one; else species."""
    return F.when((chains == 1) | (n_separators(name) >= chains - 1), F.lit("Molecular level")).otherwise(F.lit("Sum composition - Species level"))


def sample_name(name: Column) -> Column:
    """Without polarity marks, what follows _P1 or _P2, and separators at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\[?POS\]?|\[?NEG\]?", ""), r"^[PN]_", ""), r"(?s)_P[12].*$", "")
    return F.regexp_replace(plain, r"^[_\- ]+|[_\- ]+$", "")


def number_in(text: Column) -> Column:
    """P20: the first number of a text with a percent sign or a decimal comma; null without one."""
    return F.regexp_extract(F.regexp_replace(F.replace(text, F.lit("%"), F.lit("")), ",", "."), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def standard_name(name: Column) -> Column:
    """Without parenthesized parts."""
    return F.trim(F.regexp_replace(name, r"\s*\(.*?\)", ""))


def motifs(name: Column, single_chain: Column | None = None, sum_composition: Column | None = None) -> Column:
    """The distinct chains of a name that are accepted as fatty-acid motifs: two or more, with a separator, or of a
    class with one chain, or that is only known as a sum composition (both conditions, false if they are not given)."""
    text = F.coalesce(name, F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{1,2}:\d{1,2}"), F.lit(0)))
    accepted = (F.size(found) >= 2) | text.rlike("[_/;]")
    for more in (single_chain, sum_composition):
        accepted = accepted if more is None else accepted | F.coalesce(more, F.lit(False))
    return F.when(accepted, found).otherwise(F.array().cast("array<string>"))


def quality(msms: Column, msigma: Column, dmz: Column, rsd: Column) -> Column:
    """P25: how well a feature was measured, from 0 to 1; nulls count as the worst usual value."""

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    return (
        F.lit(0.4) * unit(F.coalesce(msms, F.lit(0.0)) / 1000)
        + F.lit(0.2) * unit(1 - F.coalesce(msigma, F.lit(100.0)) / 250)
        + F.lit(0.2) * unit(1 - F.abs(F.coalesce(dmz, F.lit(3.0))) / 5)
        + F.lit(0.2) * unit(1 - F.coalesce(rsd, F.lit(30.0)) / 30)
    )


def class_of(head: Column, known: Column, name: Column | None = None) -> Column:
    """The class that a headgroup has in the list (`known`, null if it has none), empty without a headgroup, NA for NA, else Other.

    With the name, which search results have, three words in it tell a class before Other.
    """
    group = F.trim(F.coalesce(head, F.lit("")))
    out = F.when(group.isin("", "nan"), F.lit("")).when(group == "NA", F.lit("NA")).when(known.isNotNull(), known)
    if name is not None:
        out = out.when(F.upper(group) == "NA", F.lit("NA")).when(name.contains("GlcAbeta-Cer"), F.lit("HexCer")).when(name.contains("Cer("), F.lit("Cer")).when(name.contains("sterol"), F.lit("ST"))
    return out.otherwise(F.lit("Other"))


def first_chain(text: Column, part: int) -> Column:
    """The carbons (part 1) or double bonds (part 2) of the first chain in a text, blanks around the colon allowed; null without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)\s*:\s*(\d+)", part).try_cast("double")


# Groups of classes, and the names of classes in each; of a name in two groups the later group counts.
CLASS_GROUPS = (
    ("CAR", ("CAR", "Car")), ("CoA", ("CoA",)), ("FA", ("FA",)), ("FAHFA", ("FAHFA",)), ("FAL, FAG, FOH, HC", ("FAG", "HC")), ("FAL, FOH", ("FAL", "FOH")),
    ("NA, NAE, NAT", ("NAT",)), ("NA, NAE", ("NA", "NAx", "NAE")), ("WE", ("WE",)), ("MG", ("MG",)), ("DG", ("DG",)), ("TG", ("TG", "TG O-")),
    ("HexDG, HexMG", ("Hex2DG", "HexDG", "Hex2MG", "HexMG")), ("DGTA, DGTS, DGCC, GlcADG", ("DGTA", "DGTS", "DGCC", "GlcADG", "G")), ("SQDG, SQMG", ("SQDG", "SQMG")),
    ("PA", ("PA O-", "PA", "PPA")), ("LPA", ("LPA O-", "LPA")), ("PC", ("PC O-", "PC", "PnC")), ("LPC", ("LPC O-", "LPC")), ("PE", ("PE O-", "PE", "PnE")),
    ("LPE", ("LPE O-", "LPE")), ("PEth", ("PEth",)), ("PG", ("PG O-", "PG")), ("LPG", ("LPG O-", "LPG")), ("PI", ("PI O-", "PI")), ("LPI", ("LPI O-", "LPI")),
    ("PS, PS-NAc", ("PS", "PS-NAc")), ("LPS", ("LPS O-", "LPS")), ("CL", ("CL",)), ("MLCL", ("MLCL",)), ("DLCL", ("DLCL",)), ("BMP", ("BMP", "LBPA")), ("PIM", ("PIM",)),
    ("GP, Glc-GP", ("GP", "Glc-GP", "CDP-DG", "PT", "LPT")), ("ACer", ("ACer", "AC")), ("Cer", ("C", "Cer")), ("CerP", ("CerP",)),
    ("HexCer, GlcCer", ("HexCer", "GlcCer", "H")), ("LSM", ("LSM",)), ("MIPC, M(IP)2C", ("MIPC", "M(IP)2C", "IPC")), ("PE-Cer, PI-Cer", ("PE-Cer", "PI-Cer", "CerPE", "CerPI")),
    ("SCer", ("SCer",)), ("SM", ("SM",)), ("SPB, HexSPB, SPBP", ("HexSPB", "SPB", "SPBP")), ("CE", ("CE",)), ("ST", ("ST", "SFE")), ("PK", ("PK",)), ("PR", ("PR",)), ("SL", ("SL",)),
    ("Other", ("N", "")),
)


def class_group(lipid_class: Column, unknown: str = "append") -> Column:
    """The group that a class is reported in; a class in none is its own group (append), or Other."""
    if unknown not in ("append", "other"):
        raise ValueError(f"unknown is append or other, not {unknown!r}")
    name = F.trim(F.coalesce(lipid_class, F.lit("")))
    out = F.lit(None).cast("string")
    for group, names in CLASS_GROUPS:
        out = F.when(name.isin(*names), F.lit(group)).otherwise(out)
    return F.coalesce(out, name if unknown == "append" else F.lit("Other"))
