"""Column builders for symbolic sequences: k-mers, ranks, complements, ambiguity, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
DNA, METHYL = "ACGT", "ACEGT"  # E: 5-methylcytosine
OPTIONS = {"variant": "ACGT", "cytosine2": "CE", "cytosine3": "CEO", "adenosine": "AI"}
AMBIGUOUS = "X"


def at(s: Column, start: Column | int, n: Column | int) -> Column:
    """n characters from the 0-based place `start`."""
    start, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, n))
    return s.substr(start.cast("int") + 1, n.cast("int"))


def kmers(s: Column, k: int) -> Column:
    """Array of all full k-mers in order; empty if the sequence is shorter than k. One pass, however long the text."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def kmer_rank(kmer: Column, alphabet: str, k: int) -> Column:
    """Base-n number of a k-mer, the first character most significant; null if a character is not in the alphabet."""
    digit = [F.instr(F.lit(alphabet), at(kmer, i, 1)) - 1 for i in range(k)]
    legal = (F.length(kmer) == k) & (F.translate(kmer, alphabet, "") == "")
    return F.when(legal, sum((d.cast("long") * len(alphabet) ** (k - 1 - i) for i, d in enumerate(digit)), F.lit(0).cast("long")))


def rank_kmer(rank: Column, alphabet: str, k: int) -> Column:
    """The k-mer of a rank."""
    n = len(alphabet)
    return F.concat(*[at(F.lit(alphabet), F.floor(rank / F.lit(n ** (k - 1 - i))) % n, 1) for i in range(k)])


def multiset(kmer: Column) -> Column:
    """The characters of a k-mer in order: equal for k-mers with equal composition."""
    return F.array_join(F.array_sort(F.split(kmer, "")), "")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTE", "TGCAG")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def reads_forward(strand: Column, forward: Column) -> Column:
    """Whether a strand's series runs along the reference: template of forward, complement of backward reads."""
    return ((strand == "t") & forward) | ((strand == "c") & ~forward)


def strand_kmer(kmer: Column, strand: Column, forward: Column) -> Column:
    return F.when(reads_forward(strand, forward), kmer).otherwise(reverse_complement(kmer))


def reference_position(x: Column, offset: Column, length: Column, k: int, strand: Column, forward: Column) -> Column:
    """Position on the forward reference of k-mer x of a slice that starts at `offset`."""
    return F.when(reads_forward(strand, forward), x + offset).otherwise((length - k) - (x + (length - offset)))


def query_position(i: Column, k: int, strand: Column, forward: Column) -> Column:
    return F.when(reads_forward(strand, forward), i).otherwise(k - 1 - i)


def site_range(site: Column, k: int) -> Column:
    """The positions whose k-mers lie over a site."""
    return F.sequence(site - (k - 1), site)


def ambiguous_positions(kmer: Column, k: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(kmer, i, 1) == AMBIGUOUS)


def _append(choice: Column):
    return lambda head: F.transform(choice, lambda o: F.concat(head, o))


def expand_ambiguous(kmer: Column, k: int, options: str) -> Column:
    """All k-mers that an ambiguous one stands for, the last place varying fastest."""
    out = F.array(F.lit(""))
    for i in range(k):
        c = at(kmer, i, 1)
        choice = F.when(c == AMBIGUOUS, F.array(*[F.lit(o) for o in options])).otherwise(F.array(c))
        out = F.flatten(F.transform(out, _append(choice)))
    return out


def legal_transition(a: Column, b: Column, k: int) -> Column:
    """Whether k-mer b may follow a: they overlap by k - 1; null is free."""
    return a.isNull() | b.isNull() | (at(a, 1, k - 1) == at(b, 0, k - 1))


def overlap_shift(a: Column, b: Column, k: int) -> Column:
    """The least i >= 1 by which b continues a, else k."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.substring(a, i + 1, F.lit(k)) == F.substring(b, F.lit(1), F.lit(k) - i))
    return F.coalesce(F.array_min(fits), F.lit(k))


def motif_positions(s: Column, motif: str) -> Column:
    """0-based places at which a motif starts, overlaps included."""
    m = len(motif)
    return F.when(F.length(s) >= m, F.filter(F.sequence(F.lit(0), F.length(s) - m), lambda i: at(s, i, m) == motif)).otherwise(F.array().cast("array<int>"))


def strided_mask(s: Column, step: int, register: Column) -> Column:
    """Every step-th character, from `register` on, replaced by the ambiguity character."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(i % step == register, F.lit(AMBIGUOUS)).otherwise(c)), "")


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    counts, ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(counts, ops, lambda n, op: F.struct(n.cast("long").alias("n"), op.alias("op")))


def cigar_span(ops: Column, kinds: str) -> Column:
    """Summed length of the operations of some kinds."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, o: acc + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["n"]).otherwise(0))
