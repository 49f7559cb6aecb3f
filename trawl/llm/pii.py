r"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Four kinds of entities are found by pattern and rule (``KINDS``). Then the
corpus tells which other terms give protected entities away. An entity counts
for three classes: itself, its neighbourhood (an e-mail's domain, the first two
parts of an address, the first six digits of a card, five of a phone number)
and its kind, so that entities that occur once have company. Term t discloses
class g if

    log2(P(g | t) / P(g)) >= DISCLOSURE * -log2(P(g)),
    P(g | t) = (m r + STRENGTH P(g)) / (m + STRENGTH),   r = n(t, g) / n(t)

where n(t, g) counts documents in which t stands within ``CONTEXT`` characters
of an entity of g, n(t) documents with t, and m the different texts among the
first: what few texts say is drawn to P(g), so there is no threshold of
support, and no copies of one text make evidence. (Without that pull, at 1 the
term occurs beside g only.) Entities are generalised to their kind's label;
disclosing terms are removed from documents that have an entity of the class.
Terms are runs of letters and digits outside entities, in lower case (what an
entity leaves of a longer run is no term, unless it is one elsewhere).

Words and entities of a text meet by stretches of ``CONTEXT`` characters, so
what a text costs is in proportion to its length, whatever it holds.

Patterns are written so that they run in linear time, without deep recursion:
with possessive quantifiers, and starting only where a run of their characters
starts or the last match ended, which matches the same spans.

Edge cases: a null text is empty; a null ``doc_id`` and repeated rows get
their own results; an empty table gives an empty result; columns of other names
pass through ``sanitise`` unchanged, also where they are called as ours; ties
don't arise, as every term is decided on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.staging import staged

# fixed values: the patterns of the four kinds, in their order
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What terms are, and the kind that their spans carry.
TERM, TERM_KIND = r"[\p{L}\p{N}]+", "term"
#: Texts that the share of a class in all documents counts as, beside the texts seen.
STRENGTH = 0.5
DISCLOSURE = 0.9
#: Characters on each side of an entity that are its context.
CONTEXT = 200
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Spans gathered before they go to the list of full groups, so that no long list is copied again and again.
_GROUP = 512


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def located(text: str, pattern: str) -> Column:
    """All matches of ``pattern`` in the column ``text``: array of (a, b, m), start and end in code points."""
    span = "array<struct<a:int,b:int,m:string>>"
    rx = _quoted(pattern)
    found = f"regexp_extract_all({text}, {rx}, 0)"
    here = "named_struct('a', acc.at + length(x.p), 'b', acc.at + length(x.p) + length(x.m), 'm', x.m)"
    return F.expr(
        f"""CASE WHEN regexp_like({text}, {rx}) THEN aggregate(
            zip_with(split({text}, {rx}, -1), {found}, (p, m) -> named_struct('p', p, 'm', m)),
            named_struct('at', 0, 'last', CAST(array() AS {span}), 'full', CAST(array() AS array<{span}>)),
            (acc, x) -> named_struct('at', acc.at + length(x.p) + coalesce(length(x.m), 0),
                'last', CASE WHEN x.m IS NULL THEN acc.last WHEN size(acc.last) >= {_GROUP} THEN array({here}) ELSE concat(acc.last, array({here})) END,
                'full', CASE WHEN x.m IS NOT NULL AND size(acc.last) >= {_GROUP} THEN concat(acc.full, array(acc.last)) ELSE acc.full END),
            acc -> concat(flatten(acc.full), acc.last)) ELSE CAST(array() AS {span}) END"""
    )


def _luhn(digits: str) -> str:
    digit = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT)"
    doubled = f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {doubled} ELSE {digit} END) % 10 = 0"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_VALID = {
    "email": None,
    "ip": f"regexp_like(x.m, r'^{_PART}(?:\\.{_PART}){{3}}$')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _found(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """``carried`` columns with ``_text`` and, per kind, the valid spans."""
    raw = docs.select(*carried, F.coalesce(docs["text"], F.lit("")).alias("_text"))
    raw = raw.select("*", *[located("_text", rx).alias(f"_{k}") for k, rx in KINDS.items()])
    return raw.select(*raw.columns[: len(carried) + 1], *[F.expr(f"filter(_{k}, x -> {rule})" if rule else f"_{k}").alias(f"_{k}") for k, rule in _VALID.items()])


def _spans(kinds: list[str]) -> Column:
    """One array of (k, a, b, m) of several kinds, by kind, then start."""
    return F.expr("concat(" + ", ".join(f"transform(_{k}, x -> named_struct('k', '{k}', 'a', x.a, 'b', x.b, 'm', x.m))" for k in kinds) + ")")


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.k, ':', x.a, ':', x.b)), ',')")


_CLASSES = f"""CASE x.k
    WHEN 'email' THEN array('email', concat('email@', lower(substring_index(x.m, '@', -1))), concat('email:', lower(x.m)))
    WHEN 'ip' THEN array('ip', concat('ip/', substring_index(x.m, '.', 2)), concat('ip:', x.m))
    WHEN 'card' THEN array('card', concat('card/', left({_DIGITS}, 6)), concat('card:', {_DIGITS}))
    ELSE array('phone', concat('phone/', left({_DIGITS}, 5)), concat('phone:', {_DIGITS})) END"""


def _masked(spans: str) -> Column:
    """``_text`` with spaces for the characters of the spans."""
    sorted_ = f"array_sort(transform({spans}, x -> named_struct('a', x.a, 'b', x.b)))"
    # a piece is what lies before a span, and the span's blanks; nothing of what an earlier span covers
    return F.expr(
        f"""aggregate({sorted_}, named_struct('at', 0, 'parts', CAST(array() AS array<string>)),
        (acc, x) -> CASE WHEN x.b <= acc.at THEN acc ELSE named_struct('at', x.b, 'parts', concat(acc.parts,
            array(substring(_text, acc.at + 1, greatest(x.a - acc.at, 0)), repeat(' ', x.b - greatest(x.a, acc.at))))) END,
        acc -> concat(array_join(acc.parts, ''), substring(_text, acc.at + 1)))"""
    )


def tokens_of(held: DataFrame) -> DataFrame:
    """(_row, a, b, term): the terms outside entities of the rows with entities, staged."""
    rx = _quoted(TERM)
    free = held.select("_row", _masked("_base").alias("_free")).where(F.expr(f"regexp_like(_free, {rx})"))
    parts = free.select("_row", F.posexplode(F.expr(f"zip_with(split(_free, {rx}, -1), regexp_extract_all(_free, {rx}, 0), (p, m) -> named_struct('p', length(p), 'm', m))")).alias("_at", "x"))
    # places are running sums of lengths; a row's parts are no more than its text
    so_far = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.select("_row", F.col("x.m").alias("m"), F.sum(F.col("x.p") + F.coalesce(F.length("x.m"), F.lit(0))).over(so_far).cast("int").alias("b")).where("m IS NOT NULL")
    return staged(ends.select("_row", (F.col("b") - F.length("m")).alias("a"), "b", F.lower("m").alias("term")), "terms-held")


def _documents(rows: DataFrame, text: str) -> DataFrame:
    """(_h, _n): by the 64-bit hash of a term, how many rows have it. Every task sums its own before they go anywhere."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: F.xxhash64(F.lower(m))))
    return rows.select(F.explode(terms).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))


def disclosing(docs: DataFrame, held: DataFrame, tokens: DataFrame, disclosure: float = DISCLOSURE, strength: float = STRENGTH, context: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(class, term) pairs that disclose, and (_row, class). ``held``: the rows with entities, as (_row, _text, _base)."""
    texts = held.groupBy(F.sha2("_text", 256).alias("_digest")).agg(F.count("*").alias("_copies"), F.min("_row").alias("_row")).drop("_digest")
    classes = staged(held.select("_row", F.explode(F.expr(f"array_distinct(flatten(transform(_base, x -> {_CLASSES})))")).alias("class")), "classes")
    total = F.lit(docs.count()).cast("double")
    shares = classes.groupBy("class").agg((F.count("*") / total).alias("_p"))
    # words and entities of a row meet by stretches of the text
    spans = held.select("_row", F.explode("_base").alias("x")).select("_row", "x.a", "x.b", F.expr(_CLASSES).alias("_of"))
    spans = spans.select("_row", F.col("a").alias("_a"), F.col("b").alias("_b"), "_of", F.explode(F.expr(f"sequence(cast(floor((a - {context}) / {context}) AS INT), cast(floor((b + {context}) / {context}) AS INT))")).alias("_stretch"))
    near = tokens.withColumn("_stretch", F.floor(F.col("a") / context).cast("int")).join(spans.join(texts, "_row").hint("merge"), ["_row", "_stretch"])
    # by sorting at every size: both sides grow with the input
    near = near.where(f"b > _a - {context} AND a < _b + {context}").select("_row", "_copies", "term", F.explode("_of").alias("class")).distinct()
    pairs = near.groupBy("class", "term").agg(F.sum("_copies").cast("double").alias("_nte"), F.count("*").alias("_texts"))

    def reaches(n: str) -> Column:
        shrunk = (F.col("_texts") * F.least(F.col("_nte") / F.col(n), F.lit(1.0)) + strength * F.col("_p")) / (F.col("_texts") + strength)
        return F.log2(shrunk / F.col("_p")) >= -disclosure * F.log2("_p")

    # a term that can't reach the threshold in the rows with entities alone can't when all are counted
    at_least = _documents(held.select(_masked("_base").alias("_free")), "_free").withColumnRenamed("_n", "_least")
    possible = pairs.join(shares, "class").where(reaches("_nte"))
    possible = staged(possible.withColumn("_h", F.xxhash64("term")).join(at_least, "_h").where(reaches("_least")).drop("_least"), "possible-pairs")
    counts = _documents(docs, "text").withColumnRenamed("_n", "_nt")
    return possible.join(counts, "_h").where(reaches("_nt")).select("class", "term"), classes


def _term_spans(docs: DataFrame, held: DataFrame, disclosure: float, strength: float) -> DataFrame:
    """(_row, _terms): the disclosing terms of the rows that have any, as spans."""
    tokens = tokens_of(held)
    risky, classes = disclosing(docs, held, tokens, disclosure, strength)
    hit = tokens.join(staged(risky, "disclosing"), "term").join(classes, ["_row", "class"], "left_semi")
    span = F.struct(F.lit(TERM_KIND).alias("k"), "a", "b", F.col("term").alias("m"))
    return staged(hit.groupBy("_row").agg(F.array_sort(F.collect_set(span)).alias("_terms")), "term-spans")


def _with_spans(docs: DataFrame, carried: list[Column], disclosure: float, strength: float) -> DataFrame:
    """``carried`` columns with ``_base`` and ``_terms``, and ``_text`` where there are base spans."""
    found = _found(docs, carried)
    base = found.select(*found.columns[: len(carried)], "_text", _spans(list(KINDS)).alias("_base"), F.monotonically_increasing_id().alias("_row"))
    base = staged(base.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))), "base-spans")
    held = base.where("_text IS NOT NULL").select("_row", "_text", "_base")
    return base.join(_term_spans(docs, held, disclosure, strength), "_row", "left")


def detect(docs: DataFrame, disclosure: float = DISCLOSURE, strength: float = STRENGTH) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, and all spans as a string."""
    rows = _with_spans(docs, [F.col("doc_id")], disclosure, strength)
    counts = [F.expr(f"CAST(size(filter(_base, x -> x.k = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return rows.withColumn("_all", F.concat("_base", F.coalesce("_terms", F.expr("filter(_base, x -> false)")))).select("doc_id", *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, strength: float = STRENGTH) -> DataFrame:
    """``docs`` with entities generalised to their kind, as in ``[EMAIL]``, and disclosing terms removed."""
    names = docs.columns
    rows = _with_spans(docs, [docs[f"`{n}`"].alias(f"c{k}") for k, n in enumerate(names)], disclosure, strength)
    text = f"c{names.index('text')}"
    spans = "array_sort(transform(concat(_base, coalesce(_terms, filter(_base, x -> false))), x -> named_struct('a', x.a, 'b', x.b, 'k', x.k)))"
    label = f"CASE WHEN x.k = '{TERM_KIND}' THEN '' ELSE concat('[', upper(x.k), ']') END"
    # spans may overlap: what lies in an earlier one is gone already
    built = f"""aggregate({spans}, named_struct('at', 0, 'parts', CAST(array() AS array<string>)),
        (acc, x) -> CASE WHEN x.b <= acc.at THEN acc ELSE named_struct('at', x.b, 'parts', concat(acc.parts,
            array(substring(_text, acc.at + 1, greatest(x.a - acc.at, 0)), CASE WHEN x.a < acc.at THEN '' ELSE {label} END))) END,
        acc -> concat(array_join(acc.parts, ''), substring(_text, acc.at + 1)))"""
    clean = F.expr(f"CASE WHEN _text IS NULL THEN {text} ELSE {built} END")
    return rows.select(*[(clean if f"c{k}" == text else F.col(f"c{k}")).alias(n) for k, n in enumerate(names)])
