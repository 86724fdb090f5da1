"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.session import computed

#: Kinds whose spans always stay, in the order of output, and the kinds that need a score of ``ENOUGH``.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "short_card", "local_phone")
ENOUGH = 0.5
#: Matches that are placed by one array.
RUN = 128

# What each kind looks like. Possessive quantifiers and the conditions on the place before a match change no match;
# they keep the time in proportion to the text, and the stack flat, however long a run of its letters is.
_LOCAL = "A-Za-z0-9._%+-"
# What follows the first four characters of an account number, and numbers in groups of four that their country ends with a
# whole group: a word after such a number looks like one group more.
_REST = r"(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"
_GROUPS = {3: "BE", 4: "AT|BA|EE|KZ|LT|LU|MN|XK", 5: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 6: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 7: "LC"}
_WHOLE_GROUPS = "^(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20[A-Z0-9]{{4}}){{{n}}}" for n, c in _GROUPS.items()) + ")"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?={_REST})",
    "local_phone": r"(?<![0-9+.-])0[0-9][\x20()./0-9-]{5,16}[0-9](?![0-9])",
}
# Prior score of a kind, what a checksum adds that holds, and what a word nearby adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "short_card": 0.0, "local_phone": 0.2}
CHECKED = {"card": 0.4, "iban": 0.6, "short_card": 0.3}
NEARBY, REACH = 0.3, 40
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|adresse|dirección|server|host",
    "card": "card|visa|credit|kredit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil|handy|móvil",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "short_card": "card|visa|amex|credit|kredit|karte|carte|tarjeta",
    "local_phone": "phone|tel|call|fax|mobil|handy|móvil",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end and
    letters read as 10 to 35."""
    moved = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    value = F.aggregate(
        moved,
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97,
    )
    return value == 1


def _placed(matches: Column, gaps: Column) -> Column:
    """Start and end (code points) of matches, from the lengths of the texts between them and their own.

    Appending to an array copies it, so matches are placed in runs of ``RUN``: the runs' lengths are added up first, and
    each run is placed from where it begins. That takes time in proportion to the matches."""
    span = "array<struct<start:int,end:int,text:string>>"
    runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))

    def cut(x: Column, i: Column) -> Column:
        return F.slice(x, i * RUN + 1, F.lit(RUN))

    def length(i: Column) -> Column:
        return F.aggregate(F.transform(cut(gaps, i), lambda g: F.length(g)), F.lit(0), lambda a, n: a + n) + F.aggregate(
            F.transform(cut(matches, i), lambda m: F.length(m)), F.lit(0), lambda a, n: a + n
        )

    def begun(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(F.transform(runs, length), none, begun, lambda acc: acc["out"])

    def run(i: Column, begin: Column) -> Column:
        own, between = cut(matches, i), cut(gaps, i)
        start = F.struct(begin.alias("at"), F.array().cast(span).alias("out"))

        def add(acc: Column, pair: Column) -> Column:
            first = acc["at"] + F.length(pair["g"])
            last = first + F.length(pair["m"])
            placed = F.struct(first.alias("start"), last.alias("end"), pair["m"].alias("text"))
            return F.struct(last.alias("at"), F.array_append(acc["out"], placed).alias("out"))

        # The gap after the last match of all has none beside it.
        pairs = F.filter(F.zip_with(between, own, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda p: p["m"].isNotNull())
        return F.aggregate(pairs, start, add, lambda acc: acc["out"])

    some = F.flatten(F.zip_with(runs, begins, run)).cast(span)
    return F.when(F.size(matches) > 0, some).otherwise(F.array().cast(span))


def _holds(kind: str, x: Column) -> Column:
    """Whether a match passes the check of its kind; long runs are turned down before they are taken apart."""
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substr(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return F.when(n.between(low, high), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "local_phone":
        return n.between(8, 13)
    if kind == "iban":
        plain = F.replace(x, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _accounts(text: Column, heads: Column) -> Column:
    """Account numbers that hold, from the places of their first four characters: the longest match, or its part of the
    length that the country fixes if that holds; of those that overlap the leftmost."""
    kind = "struct<at:int,out:array<struct<start:int,end:int,text:string>>>"
    longest = F.transform(heads, lambda h: F.struct(h["start"].alias("start"), F.regexp_extract(F.substr(text, h["start"] + 1, F.lit(44)), "^[A-Z]{2}[0-9]{2}" + _REST, 0).alias("text")))
    both = F.transform(longest, lambda s: F.struct(s["start"].alias("start"), F.array(F.regexp_extract(s["text"], _WHOLE_GROUPS, 0), s["text"]).alias("texts")))
    held = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.get(F.filter(s["texts"], lambda x: _holds("iban", x)), F.lit(0)).alias("text")))

    def add(acc: Column, s: Column) -> Column:
        last = s["start"] + F.length(s["text"])
        span = F.struct(s["start"].alias("start"), last.alias("end"), s["text"].alias("text"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(last.alias("at"), F.array_append(acc["out"], span).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)
    return F.aggregate(F.filter(held, lambda s: s["text"].isNotNull()), begin, add, lambda acc: acc["out"])


def _scored(kind: str, text: Column, spans: Column) -> Column:
    """Spans that hold, each with its kind and score; added kinds only from ``ENOUGH`` on."""

    def score(span: Column) -> Column:
        low = F.greatest(span["start"] - REACH, F.lit(0))
        around = F.lower(F.substr(text, low + 1, span["end"] - low + REACH))
        near = F.when(around.rlike(WORDS[kind]), NEARBY).otherwise(0.0)
        sure = F.least(F.lit(PRIOR[kind] + CHECKED.get(kind, 0.0)) + near, F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.round(sure, 3).alias("score"), span["text"].alias("text"))

    scored = F.transform(F.filter(spans, lambda s: _holds(kind, s["text"])), score)
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= ENOUGH)


def find(documents: DataFrame) -> DataFrame:
    """Add ``spans`` to every document: ``kind``, ``start``, ``end`` (code points, end exclusive), ``score`` and ``text`` of the
    personal data in its whole ``text``, by kind and then by place.

    Of each kind the leftmost matches that do not overlap are candidates (of account numbers, those that hold); kinds may overlap
    each other. An account number in groups ends where its country's length does, if it holds there. Addresses,
    cards (Luhn) and phones of the base kinds stay if their check holds. Account numbers (mod 97), shorter cards and phones without
    a country code are added if prior, checksum and words within ``REACH`` make a score of ``ENOUGH``.

    Defined results: a null or empty text has no spans (an empty list); rows may repeat; an empty table gives an empty
    one; a column named ``spans`` is replaced, and columns named like ``__t`` or a kind with two underscores
    before it are used up. Functions of Spark only; a text is one row's work, in proportion to its length.
    """
    text = F.col("__t")
    digit = text.rlike("[0-9]")
    worth = {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")),
        "local_phone": text.rlike(r"0[0-9][\x20()./0-9-]{5}"),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
    }
    rows = documents.drop("spans", "__t").withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<string>")
    rows = computed(rows, {f"__{k}": F.when(worth.get(k, digit), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    # Most texts have no match of a kind: only the others are taken apart.
    rows = computed(rows, {f"__between_{k}": F.when(F.size(f"__{k}") > 0, F.split(text, p, -1)) for k, p in PATTERNS.items()})
    rows = computed(rows, {f"__{k}": _placed(F.col(f"__{k}"), F.col(f"__between_{k}")) for k in PATTERNS})
    rows = computed(rows, {"__iban": F.when(F.size("__iban") > 0, _accounts(text, F.col("__iban"))).otherwise(F.col("__iban"))})
    found = [_scored(k, text, F.col("__card" if k == "short_card" else f"__{k}")) for k in BASE + ADDED]
    rows = computed(rows, {"spans": F.concat(*found)})
    return rows.drop("__t", *[f"__{k}" for k in PATTERNS], *[f"__between_{k}" for k in PATTERNS])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, kinds: tuple[str, ...] = BASE + ADDED) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span of personal data in ``text`` replaced by its kind in angle brackets; of overlapping
    spans the earliest and then longest counts. Null texts stay null."""
    inner = "array<struct<start:int,stop:int,kind:string>>"
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind")))).cast(inner)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        added = F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["stop"]).alias("at"), added.alias("out")))

    whole = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    return find(documents).withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))).drop("spans")
