"""Sequence functions as Columns: they stay in the JVM and inside generated code where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dictionary import Dictionary

#: Codes for two bases.
IUPAC = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq) -> Column:
    """Reverse complement; case and N are kept."""
    return F.reverse(F.translate(col(seq), "ACGTNacgtn", "TGCANtgcan"))


def cigar_ops(cigar) -> Column:
    """Array of (n, op) of an extended CIGAR."""
    found = F.regexp_extract_all(col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_indel_bp(cigar) -> Column:
    """Bases inserted or deleted by a CIGAR."""
    sizes = F.regexp_extract_all(col(cigar), F.lit(r"(\d+)[ID]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def apply_change(seq, kind, start, end, bases) -> Column:
    """One template change; start and end are 1-based. delete_insert keeps both of its bounds."""
    seq, kind, start, end, bases = map(col, (seq, kind, start, end, bases))
    head = F.substring(seq, F.lit(1), start - 1)
    insert = F.concat(head, bases, F.substring(seq, start, F.length(seq)))
    delete = F.concat(head, F.substring(seq, end + 1, F.length(seq)))
    both = F.concat(F.substring(seq, F.lit(1), start), bases, F.substring(seq, end, F.length(seq)))
    return F.when(kind == "insert", insert).when(kind == "delete", delete).when(kind == "delete_insert", both).otherwise(seq)


def net_change(kind, start, end, bases) -> Column:
    kind, start, end, bases = map(col, (kind, start, end, bases))
    return F.when(kind == "insert", F.length(bases)).when(kind == "delete", start - end - 1).otherwise(F.length(bases) - (end - start - 1))


def runs(seq, least: int) -> Column:
    """Homopolymer runs of at least ``least`` bases: array of (start, end, base), 0-based half-open."""
    pieces = F.regexp_extract_all(col(seq), F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x)).alias("at"),
        F.when(F.length(x) >= least, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), F.substring(x, 1, 1).alias("base"))))).otherwise(acc["found"]).alias("found"),
    )
    none = F.array().cast("array<struct<start:int,end:int,base:string>>")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]


def boundary_insert(inserted, left, right) -> Column:
    """An insertion at the border of runs without the run bases at its ends."""
    text = col(inserted)
    text = F.when(col(left).isNotNull(), F.regexp_replace(text, F.concat(F.lit("^"), col(left), F.lit("+")), F.lit(""))).otherwise(text)
    return F.when(col(right).isNotNull(), F.regexp_replace(text, F.concat(col(right), F.lit("+$")), F.lit(""))).otherwise(text)


def mean_quality(quality) -> Column:
    """Mean Phred-33 quality; 0 for none."""
    q = F.coalesce(col(quality), F.lit(""))
    total = F.aggregate(F.transform(F.array_remove(F.split(q, ""), ""), lambda c: F.ascii(c) - 33), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(q) > 0, total / F.length(q)).otherwise(F.lit(0.0))


def hamming(a, b) -> Column:
    """Differing places of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def substitutions_only(a, b) -> Column:
    a, b = col(a), col(b)
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == hamming(a, b))


def contig(n, words: Dictionary, flank: int) -> Column:
    """Flank, the first fixed units, ``n`` canonical units, the last fixed units, flank."""
    head = "".join(words.units[u] for u in ("1", "2", "3", "4", "5") if u in words.units)
    tail = "".join(words.units[u] for u in ("6", "7", "8", "9") if u in words.units)
    left = words.left[-flank:] if flank else ""
    return F.concat(F.lit(left + head), F.repeat(F.lit(words.units[words.canonical]), col(n)), F.lit(tail + words.right[:flank]))


def find_anchor(seq, anchor, expected, tolerance: int) -> Column:
    """1-based start of the exact anchor whose start is within ``tolerance`` of ``expected``; null if none."""
    first = F.greatest(col(expected) - tolerance, F.lit(1))
    window = F.substring(col(seq), first, F.length(col(anchor)) + 2 * tolerance)
    place = F.call_function("locate", col(anchor), window)
    return F.when(place > 0, first + place - 1)


def unique_place(seq, anchor) -> Column:
    """1-based start of an anchor that occurs exactly once, else null."""
    first = F.call_function("locate", col(anchor), col(seq))
    second = F.call_function("locate", col(anchor), col(seq), first + 1)
    return F.when((first > 0) & (second == 0), first)


def crop(seq, left, right) -> Column:
    """From the end of the left to the start of the right anchor, each unique and in order; else null."""
    a, b = unique_place(seq, left), unique_place(seq, right)
    start = a + F.length(col(left))
    return F.when(b >= start, F.substring(col(seq), start, b - start))


def is_dna(seq, ambiguous: bool = False) -> Column:
    return F.coalesce(col(seq).rlike("^[ACGTRYSWKMBDHVN]+$" if ambiguous else "^[ACGT]+$"), F.lit(False))


def haploid_genotype(ad, af=None, alt_at: float = 0.5, ref_under: float = 0.2) -> Column:
    """Genotype of reads of one allele from depths "ref,alt,...", or from alternatives' fractions where those say nothing.

    i/i for the first alternative with the largest share if that is ``alt_at`` or more, 0/0 below ``ref_under``, else null.
    """
    depths = F.transform(F.split(col(ad), ","), lambda x: x.try_cast("int"))
    total = F.aggregate(depths, F.lit(0), lambda a, x: a + x)  # null if any is malformed
    shares = F.when((F.size(depths) > 1) & (total > 0), F.transform(F.slice(depths, 2, F.size(depths)), lambda x: x / total))
    if af is not None:
        values = F.transform(F.filter(F.split(col(af), ","), lambda x: x != "."), lambda x: x.try_cast("double"))
        shares = F.coalesce(shares, F.when((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull()), values))
    best = F.array_max(shares)
    index = F.array_position(shares, best).cast("string")
    return F.when(best >= alt_at, F.concat(index, F.lit("/"), index)).when(best < ref_under, F.lit("0/0"))


def is_frameshift(ref, alt) -> Column:
    ref, alt = col(ref), col(alt)
    return ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$") & (F.pmod(F.length(alt) - F.length(ref), F.lit(3)) != 0)


def selected_allele(ref, alts, genotype, haplotype: int | None) -> Column:
    """The allele of a haplotype (1 or 2); without one, the two merged: equal alleles, a base code, or the one differing length.

    ``alts`` is comma-separated. Null where the genotype is no valid pair or the two can't be merged.
    """
    alleles = F.concat(F.array(col(ref)), F.split(col(alts), ","))
    places = F.transform(F.split(col(genotype), r"[/|]"), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int")))
    picked = F.transform(places, lambda i: F.get(alleles, i))
    valid = (F.size(places) == 2) & F.forall(picked, lambda x: x.isNotNull())
    one, two = F.get(picked, F.lit(0)), F.get(picked, F.lit(1))
    if haplotype is not None:
        return F.when(valid, F.get(picked, F.lit(haplotype - 1)))
    code = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    plain = (F.length(col(ref)) == 1) & one.rlike("^[ACGT]$") & two.rlike("^[ACGT]$")
    other = F.filter(picked, lambda x: x != col(ref))
    longer = F.when((F.size(other) == 1) & (F.length(F.get(other, F.lit(0))) != F.length(col(ref))), F.get(other, F.lit(0)))
    return F.when(valid, F.when(one == two, one).when(plain, code[F.array_join(F.array_sort(picked), "")]).otherwise(longer))


def unit_class(unit, words: Dictionary) -> Column:
    """pre, after, canonical or variable."""
    unit = col(unit)
    return F.when(unit.isin(*words.pre), "pre").when(unit.isin(*words.after), "after").when(unit == words.canonical, "canonical").otherwise("variable")


def unit_category(label, words: Dictionary) -> Column:
    """As unit_class, for a segment's label: ``unit:template`` or ``unitm`` is a mutation, ``?unit`` a variant."""
    label = col(label)
    return F.when(label.contains(":") | label.rlike("m$"), "mutation").when(label.startswith("?"), "variant").otherwise(unit_class(label, words))


# What a reason's key leaves out.
REASON_LABEL = r"(?i)^allele[ _]\d+:\s*"
REASON_VARIANT = r"\([^()]* at repeat [^()]*\)"
REASON_NUMBER = r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]*\w)|\bNone\b"


def reason_key(text) -> Column:
    """A reason without what differs from case to case: allele label, variant, numbers, letter case, final stop."""
    text = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, REASON_LABEL, ""), REASON_VARIANT, "(<variant>)")
    return F.trim(F.rtrim(F.lower(F.regexp_replace(text, REASON_NUMBER, "#")), F.lit(".")))


def split_top(text) -> Column:
    """Split at "; " outside parentheses."""
    step = lambda acc, c: F.struct(
        (acc["depth"] + (c == "(").cast("int") - (c == ")").cast("int")).alias("depth"),
        F.concat(acc["text"], F.when((c == ";") & (acc["depth"] == 0), F.lit("\x01")).otherwise(c)).alias("text"),
    )
    marked = F.aggregate(F.split(col(text), ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step)["text"]
    # a semicolon without a blank after it is no separator
    folded = F.transform(F.split(marked, "\x01 "), lambda x: F.translate(x, "\x01", ";"))
    # where parentheses are closed and hold no others, a semicolon is outside if the next of them doesn't close; only other texts are folded letter by letter
    flat = col(text).rlike(r"^[^()\x01]*+(?:\([^()\x01]*+\)[^()\x01]*+)*+$")
    return F.when(flat, F.split(col(text), r"; (?![^()]*\))")).otherwise(folded)


def reason_keys(text) -> Column:
    """A reason's key, or for an inconclusive variant one key for each blocker in its parentheses."""
    pattern = r"^(.*? is inconclusive) \((.*)\)$"

    def keys(key):
        found = F.struct(F.regexp_extract(key, pattern, 1).alias("head"), F.regexp_extract(key, pattern, 2).alias("inner"))
        opened = F.transform(F.array(found), lambda m: F.transform(split_top(m["inner"]), lambda b: F.concat(m["head"], F.lit(": "), b)))
        return F.when(key.rlike(pattern), F.flatten(opened)).otherwise(F.array(key))

    # a variable of a transform is worked out once, however often it is named
    return F.flatten(F.transform(F.array(reason_key(text)), keys))


def derive_seed(*parts) -> Column:
    """63-bit seed: the first eight bytes of SHA-256 of the parts joined by bars, shifted right by one."""
    digest = F.sha2(F.concat_ws("|", *[col(p) if isinstance(p, Column) else F.lit(p) for p in parts]), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(number / 2).cast("long")


def window_half_width(length, unit_bp: int = 60) -> Column:
    return 30 + 0.6 * col(length) / unit_bp


def size_class(units, edges: tuple[int, ...] = (40, 60, 80, 120)) -> Column:
    out = F.lit(f">={edges[-1]}")
    for e in reversed(edges):
        out = F.when(col(units) < e, F.lit(f"<{e}")).otherwise(out)
    return out


def quality_weight(quality) -> Column:
    """Weight of a call by its quality: 0.3 under 5, rising from 0.5 to 1 up to 20, then 1; 0.3 without one."""
    q = col(quality)
    return F.when(q.isNull(), 0.3).when(q < 5, 0.3).when(q < 20, 0.5 + 0.5 * (q - 5) / 15).otherwise(1.0)


def amplicon(seq, forward: str, reverse: str) -> Column:
    """(start, end), 0-based half-open, of the interval between unique primer sites; null if either isn't unique."""
    a, b = unique_place(seq, F.lit(forward)), unique_place(seq, reverse_complement(F.lit(reverse)))
    return F.when(b >= a, F.struct((a - 1).alias("start"), (b - 1 + len(reverse)).alias("end")))


def option_integer(command, flag: str) -> Column:
    return F.regexp_extract(col(command), rf"(?:^|\s){flag}[ =](\S+)", 1).try_cast("int")


def four_digits(value) -> Column:
    return F.format_string("%.4g", col(value))


def common_prefix(a, b) -> Column:
    """Length of the longest common prefix."""
    a, b = col(a), col(b)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    differ = F.filter(places, lambda i: F.coalesce(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), F.lit(True)))
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, shorter))
