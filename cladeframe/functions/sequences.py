"""Column functions on sequences: case, gaps, distances, codons, names and bit vectors."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "-"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(seq) -> Column:
    """FN1: upper case without white space. Sequences are ASCII, so no letter changes length."""
    return F.upper(F.regexp_replace(column(seq), r"\s", ""))


def degap(seq) -> Column:
    """FN2"""
    return F.replace(column(seq), F.lit(GAP), F.lit(""))


def letters(seq) -> Column:
    """Array of single characters; empty for the empty text."""
    return F.filter(F.split(column(seq), ""), lambda c: c != "")


def hamming(a, b) -> Column:
    """FN3: share of differing sites among those where neither has a gap, case ignored; 0 if there is none.

    A second sequence shorter than the first is an error, as the sites are those of the first.
    """
    x, y = column(a), column(b)
    pairs = F.zip_with(letters(F.upper(x)), letters(F.upper(y)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    both = F.filter(F.slice(pairs, 1, F.greatest(F.length(x), F.lit(1))), lambda s: (s["p"] != GAP) & (s["q"] != GAP))
    unlike = F.size(F.filter(both, lambda s: s["p"] != s["q"]))
    share = F.when(F.size(both) == 0, F.lit(0.0)).otherwise(unlike / F.size(both))
    return F.when(F.length(y) < F.length(x), F.raise_error(F.lit("the second sequence is shorter"))).otherwise(share)


# The standard genetic code by first, second and third base in the order TCAG ("_" stops), and the IUPAC
# symbols of nucleotides and of ambiguous amino acids.
BASES = "TCAG"
AMINO = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
AMBIGUOUS = {"B": "ND", "Z": "EQ"}


def genetic_code() -> dict[str, str]:
    """FN7: codon to amino acid, 64 entries."""
    return dict(zip(map("".join, product(BASES, repeat=3)), AMINO))


def amino_of(codon) -> Column:
    """FN7 as a Column: null for what is no plain codon. The place of a codon in the code is a base-4 number."""
    c = F.upper(column(codon))
    digit = lambda k: F.instr(F.lit(BASES), F.substring(c, k, 1)) - 1
    return F.when(c.rlike(f"^[{BASES}]{{3}}$"), F.substring(F.lit(AMINO), digit(1) * 16 + digit(2) * 4 + digit(3) + 1, F.lit(1)))


def expansions(codon) -> Column:
    """Array of plain codons that an IUPAC codon stands for; empty if a symbol is unknown."""
    c = F.upper(column(codon))
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    at = lambda k: letters(F.coalesce(table[F.substring(c, k, 1)], F.lit("")))
    two = F.flatten(F.transform(at(1), lambda a: F.transform(at(2), lambda b: F.concat(a, b))))
    return F.flatten(F.transform(two, lambda ab: F.transform(at(3), lambda d: F.concat(ab, d))))


def aminos(codon) -> Column:
    return F.array_sort(F.array_distinct(F.transform(expansions(codon), amino_of)))


def is_compatible(codon, amino) -> Column:
    """FN5: some reading of the codon gives the amino acid; X fits all, B is N or D, Z is E or Q."""
    a, found = F.upper(column(amino)), aminos(codon)
    either = reduce(lambda x, kv: F.when(a == kv[0], F.arrays_overlap(found, F.array(*map(F.lit, kv[1])))).otherwise(x), AMBIGUOUS.items(), F.array_contains(found, a))
    return F.when(a == "X", F.lit(True)).otherwise(either)


def is_ambiguous(codon) -> Column:
    """FN6: more than one amino acid is possible."""
    return F.size(aminos(codon)) > 1


def renamed(name, suffix: int = 4, sep: str = "_") -> Column:
    """FN8: name without its last `suffix` parts, which number is an error if there are too few parts."""
    parts = F.split(column(name), sep)
    short = F.size(parts) < suffix + 1
    return F.when(short, F.raise_error(F.concat(F.lit("too few parts: "), column(name)))).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - suffix, F.lit(0))), sep))


def prior(name, sep: str = "_") -> Column:
    """FN8: the last part of a name, in millionths."""
    return F.element_at(F.split(column(name), sep), -1).cast("double") / 1e6


def safe_label(label, ordinal, prefix: str = "node") -> Column:
    """FN9: a name without punctuation, made unique by its ordinal."""
    clean = F.regexp_replace(F.coalesce(column(label), F.lit("")), r"[^A-Za-z0-9_]", "_")
    return F.concat(F.lit(prefix + "N"), F.lpad(column(ordinal).cast("string"), 6, "0"), clean)


def gcd(a: int, b: int) -> int:
    """FN10"""
    while b:
        a, b = b, a % b
    return a


def lcm(a: int, b: int) -> int:
    """FN10"""
    return a * b // gcd(a, b)


def log_base(base, x) -> Column:
    """FN11"""
    return F.log(column(x)) / F.log(column(base))


# FN12: bit vectors of any width are arrays of 64-bit words.
def bits_zip(a, b, how) -> Column:
    return F.zip_with(column(a), column(b), how)


def bits_or(a, b) -> Column:
    return bits_zip(a, b, lambda x, y: x.bitwiseOR(y))


def bits_and(a, b) -> Column:
    return bits_zip(a, b, lambda x, y: x.bitwiseAND(y))


def bits_xor(a, b) -> Column:
    return bits_zip(a, b, lambda x, y: x.bitwiseXOR(y))


def bits_count(a) -> Column:
    return F.aggregate(column(a), F.lit(0), lambda n, x: n + F.bit_count(x).cast("int"))


def bits_get(a, i) -> Column:
    return F.getbit(F.element_at(column(a), (column(i) / 64).cast("int") + 1), column(i) % 64) == 1


def bits_contain(a, b) -> Column:
    """Every bit of b is set in a."""
    return F.forall(bits_zip(a, b, lambda x, y: x.bitwiseAND(y) == y), lambda ok: ok)


def joined(items, sep: str = "()") -> Column:
    """FN13"""
    return F.array_join(column(items), sep)


def edge_number(token) -> Column:
    """FN14: the number in [n] or {n} of a newick token, null if there is none."""
    return F.nullif(F.regexp_extract(column(token), r"[\[{](\d+)[\]}]", 1), F.lit("")).cast("int")


def backtranslate(protein: DataFrame, dna: DataFrame) -> DataFrame:
    """FN4, JN9: aligned codons (name, seq) of aligned proteins and their unaligned DNA, for names in both.

    A gap becomes three gaps. Every residue takes the next three bases, which must be compatible with it; at the very
    start GTG and TTG also pass. What does not fit is an error; further bases are ignored. Case of the bases is kept.
    """
    both = protein.select("name", F.col("seq").alias("p")).join(dna.select("name", F.col("seq").alias("d")), "name")
    sites = both.select("name", "d", F.posexplode(letters("p")).alias("pos", "aa"))
    w = Window.partitionBy("name").orderBy("pos")
    sites = sites.withColumn("nth", F.sum((F.col("aa") != GAP).cast("int")).over(w))
    sites = sites.withColumn("codon", F.when(F.col("aa") == GAP, "---").otherwise(F.substr("d", F.col("nth") * 3 - 2, F.lit(3))))
    first = (F.col("nth") == 1) & F.upper("codon").isin("GTG", "TTG")
    fits = (F.col("aa") == GAP) | (F.length("codon") == 3) & (first | is_compatible("codon", "aa"))
    bad = F.raise_error(F.concat(F.lit("no codon for residue "), (F.col("pos") + 1).cast("string"), F.lit(" of "), F.col("name")))
    sites = sites.withColumn("codon", F.when(fits, F.col("codon")).otherwise(bad))
    return sites.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "codon"))), lambda s: s["codon"]), "").alias("seq"))
