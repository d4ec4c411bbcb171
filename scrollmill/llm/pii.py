"""Personal information in free text: found, and replaced by typed placeholders.

Values of a fixed form (email addresses, phone numbers, identity numbers, street addresses) are
found by their form and, where the form alone says too little, by the label before them. Names
have no form, so they are found by what terms reveal. A name stands in a frame (`Given Family`,
`Given M. Family`, `Family, Given`, `G. Family`); frames of which the lexicon knows both parts
are known persons, and the corpus tells from them how strongly the word before a frame reveals a
person. Every capitalised term is worth the sum of what its frames reveal: a known person all, any
other frame what the word before it does, and one outside the lexicon its occurrences in email
addresses too, which belong to persons. The mutual information of the term and a person is its
disclosure, in bits. A term above the threshold, or one of the lexicon, may be a part of a name; a
frame of two such parts is a person if at least one of them discloses above the threshold, so a
lexicon's words that are mostly something else (`Mark`, `Branch`) make no person by themselves.

In redaction a person's terms that disclose above the threshold are also removed where they stand
alone in the same text: they would reveal who the placeholder stands for.

One pass over the texts yields values of fixed form, frames, and counts of terms folded within
each batch; only these small rows are written and shuffled, never the texts. What terms disclose
stays a table and is joined to the frames by term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scrollmill.session import cut, small, spread

#: Least disclosure of a term, in bits, for it to count as a part of names.
LEAST_BITS = 1.0
#: Least share of a term's occurrences by which it must reveal a person.
LEAST_SHARE = 0.4
#: Least share of known persons among the frames after a word for the word to reveal a person.
LEAST_CONTEXT = 0.35

# Titles that precede names and are no part of them.
TITLES = frozenset(
    "mr mrs ms miss mx dr prof sir herr frau fräulein mme mlle monsieur madame m señor señora sr sra don doña"
    " signor signora ing dipl hr dear hi hello cc from to by the".split()
)
_FLAT, _SEP = r"[  ]", r"[-.‐-―  ]"

_EMAIL = re.compile(
    r"(?<![\w.+%@/-])[A-Za-z0-9][\w.+%'-]*"
    r"(?:@(?:[A-Za-z0-9-]+\.)+|[ ]?[\[(]at[\])][ ]?(?:[A-Za-z0-9-]+(?:\.|[ ]?[\[(]dot[\])][ ]?))+|[ ]at[ ](?:[A-Za-z0-9-]+[ ]dot[ ])+)"
    r"[A-Za-z]{2,}(?![\w@]|-\w)(?!:[\w.-]+/)",
    re.I,
)
_LABELLED = re.compile(
    r"\b(?:(?P<ssn>ssn|social(?:[ ]security)?(?:[ ](?:number|no\b\.?|nr\b\.?))?)"
    r"|(?P<nino>nino|ni[ ](?:no\b\.?|number)|national[ ]insurance(?:[ ](?:number|no\b\.?))?)"
    r"|(?P<dni>dni|nie|nif|documento(?:[ ]nacional)?[ ]de[ ]identidad)"
    r"|(?P<tax>steuer-?(?:id(?:nr\b\.?)?|nummer)|tax[ ]id(?:[ ](?:number|no\b\.?))?|tin)"
    r"|(?P<pass>(?:reise)?pass(?:port|nummer)?(?:[ ](?:number|no\b\.?|nr\b\.?))?)"
    r"|(?P<card>(?:national[ ])?id(?:entity)?[ ]card(?:[ ](?:number|no\b\.?))?|personalausweis(?:[ -]?(?:nummer|nr\b\.?))?)"
    r"|(?P<drive>driv(?:er'?s?|er’s|ing)[ ]licen[cs]e(?:[ ](?:number|no\b\.?))?))"
    r"(?:[ ](?:is|es|ist|est|lautet))?[ ]?[:=#]?[ ]?[\"'(\[]?(?P<value>[A-Z]{0,3}[- ]?\d[\dA-Z]*(?:[- ][\dA-Z]+){0,5})",
    re.I,
)
_VALUE = {
    "ssn": re.compile(r"\d{3}[- ]?\d{2}[- ]?\d{4}(?!\d)"),
    "nino": re.compile(r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]\b", re.I),
    "dni": re.compile(r"(?:[XYZ][- ]?)?\d{7,8}[- ]?[A-Z]\b", re.I),
    "tax": re.compile(r"\d{2}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)"),
    "pass": re.compile(r"[A-Z]{1,2}\d{6,8}\b|\d{9}\b", re.I),
    "card": re.compile(r"[A-Z]{1,2}\d{2}[A-Z0-9]{3,6}\d\b", re.I),
    "drive": re.compile(r"[A-Z]\d{3}-?\d{4}-?\d{4}\b|[A-Z]{1,2}\d{5,12}\b", re.I),
}
_FORMED = re.compile(r"(?<![\w.+-])(?:\d{3}-\d{2}-\d{4}|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])")
_DIGITS = re.compile(r"\d(?:[-.‐-―  ()/]{0,2}\d){6,}")
_PHONE = re.compile(
    r"(?<![\w.+:@‐-―-])(?:"
    rf"\+\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d(?:{_SEP}?\d){{6,11}}"
    rf"|00[1-9]\d{{0,2}}{_SEP}\d{{2,4}}(?:{_SEP}?\d){{5,8}}"
    rf"|(?:1{_SEP})?\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"
    rf"|(?:1{_SEP})?[2-9]\d{{2}}(?P<s>{_SEP})\d{{3}}(?P=s)\d{{4}}"
    r"|0\d(?P<f>[. ])\d{2}(?:(?P=f)\d{2}){3}"
    r"|0\d{4}[ ]\d{6}|0\d{3}[ ]\d{3}[ ]\d{4}"
    r"|\(?0\d{2,4}\)?[/-][ ]?\d{3,5}(?:[ -]?\d{2,5})?"
    r")(?![\w/]|[-.]\d)"
)
_STREET = (
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Parkway|Pkwy|Terrace|Ter|Close|Place|Pl|Square|Sq"
    r"|Crescent|Grove|Gardens|Mews|Row|Highway|Hwy|Circle|Cir|Trail)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_ADDRESS = re.compile(
    r"(?<![\w.#/-])(?:"
    rf"\d{{1,5}}[a-z]?{_FLAT}(?:(?:[NSEW]|NE|NW|SE|SW)\.?{_FLAT}|(?:North|South|East|West){_FLAT})?{_CAP}(?:{_FLAT}{_CAP})?{_FLAT}{_STREET}\b\.?"
    r"|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer)[ ]\d{1,4}[a-z]?\b"
    rf"|(?:Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|C/)[ ](?:(?:de|del|la|las|los|el)[ ])*{_CAP}(?:[ ]{_CAP})?,?[ ]\d{{1,4}}\b"
    rf"|\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|allée|boulevard|chemin|place|impasse|quai|route|cours)[ ](?:(?:de|du|des|la|le|les)[ ]|[ld]['’])*{_CAP}"
    r"|(?:P\.?[ ]?O\.?[ ]Box|Postfach|Apartado)[ ]\d{2,6}\b"
    r")(?:,[ ](?:Apt|Unit|Suite|Flat|No)\.?[ ]\w+)?(?:,[ ]\d{1,2}º[ ][A-Z])?(?:(?:,[ ]|\n)(?:\d{5}[ ])?[A-Z][a-zà-ÿ]+(?:[ ]\d{5})?(?=[\s,.;\"]|$))?"
)
_DIGIT, _TWO_DIGITS = re.compile(r"\d"), re.compile(r"\d\d")
_WORD = re.compile(r"[a-z]{3,}")
_LOWER = re.compile(r"(?<![\w@.+-])([a-z]{3,})(,[ ]|[ ][a-z]\.[ ]|[ ])([a-z]{3,})(?![\w@+]|[ ]?[\[(]at[\])])")
_BEFORE = re.compile(r"(\S+)([ \t]*)(\n?)\s*$")
_TERM = re.compile(r"\b[A-ZÀ-ÖØ-Þ][^\W\d_]*")

KINDS = ("email", "phone", "id_number", "street_address", "person_name")


def formed(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values of a fixed form in `text`; where two overlap the surer one stays."""
    out: list[tuple[int, int, str]] = []

    def put(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))

    if "@" in text or "at)" in text or "at]" in text or " dot " in text or "AT" in text:
        for m in _EMAIL.finditer(text):
            if not m[0].lower().startswith("git@"):
                put(m.start(), m.end(), "email")
    if not _DIGIT.search(text):
        return out
    if _TWO_DIGITS.search(text):
        for m in _LABELLED.finditer(text):
            if value := _VALUE[m.lastgroup if m.lastgroup != "value" else next(k for k in _VALUE if m[k])].match(text, m.start("value")):
                put(value.start(), value.end(), "id_number")
    if _DIGITS.search(text) or "QQ" in text:
        for m in _FORMED.finditer(text):
            put(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(text):
            put(m.start(), m.end(), "phone")
    for m in _ADDRESS.finditer(text):
        put(m.start(), m.end(), "street_address")
    return out


def context(text: str, start: int) -> str:
    """The word before `start`, in lower case, digits as 0; a line's end between them is marked."""
    m = _BEFORE.search(text, max(0, start - 28), start)
    return "^" if m is None else re.sub(r"[0-9]+", "0", m[1][-20:].lower()) + (m[3] and "|")


def mailbox_terms(address: str) -> list[str]:
    """The words of an email address's local part, without its tag."""
    local = re.split(r"@|[ ]?[\[(]at|[ ]at[ ]", address.lower(), maxsplit=1)[0].split("+")[0]
    return [w for w in re.split(r"[^a-zà-ÿ]+", local) if len(w) > 3]


def frames(text: str) -> tuple[list[str], list[tuple[int, int, str | None, str]]]:
    """The capitalised terms of `text`, and its name frames as (start, end, given or None, family).

    None stands for an initial in place of the given name. Terms are in lower case.
    """
    terms = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    out = []
    n = len(terms)
    for i in range(n - 1):
        (s, e), (s2, e2) = terms[i], terms[i + 1]
        if s2 - e > 2:
            continue
        gap, long1, long2 = text[e:s2], e - s > 1, e2 - s2 > 1
        if gap in (" ", " "):
            if long1 and long2:
                out.append((s, e2, text[s:e].lower(), text[s2:e2].lower()))
            elif long1 and i + 2 < n and text[e2 : terms[i + 2][0]] in (". ", " ", ".") and terms[i + 2][1] - terms[i + 2][0] > 1:
                out.append((s, terms[i + 2][1], text[s:e].lower(), text[terms[i + 2][0] : terms[i + 2][1]].lower()))
        elif gap == ", " and long1 and long2:
            out.append((s, e2, text[s2:e2].lower(), text[s:e].lower()))
        elif gap in (". ", ".") and not long1 and long2:
            out.append((s, e2, None, text[s2:e2].lower()))
    return [text[s:e].lower() for s, e in terms if e - s > 1], out


_FIELDS = [
    ("what", pa.string()), ("item_table", pa.string()), ("item_id", pa.int64()), ("kind", pa.string()),
    ("start_char", pa.int64()), ("end_char", pa.int64()), ("given", pa.string()), ("family", pa.string()),
    ("is_given", pa.bool_()), ("is_family", pa.bool_()), ("context", pa.string()), ("n", pa.int64()), ("n_mail", pa.int64()),
]
_DDL = (
    "what string, item_table string, item_id bigint, kind string, start_char bigint, end_char bigint, given string, family string,"
    " is_given boolean, is_family boolean, context string, n bigint, n_mail bigint"
)


def scan(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One pass over `items` (`item_table, item_id, text`): values, name frames and term counts.

    Rows of `what`: 'value' (a value of fixed form), 'frame' (a frame, its terms and whether the
    lexicon has them, and the word before it), 'term' (a term, its capitalised occurrences `n`
    and those in email addresses), 'lower' (two names of the lexicon in small
    letters) and 'plain' (a name of the lexicon and its occurrences in small letters). `lexicon` (`token,
    name_part`) is a list of fixed size and goes to every task.
    """
    rows = lexicon.select(F.lower("token").alias("t"), F.lower("name_part").alias("p")).dropna().collect()
    known_given = frozenset(r["t"] for r in rows if r["p"] == "given")
    known_family = frozenset(r["t"] for r in rows if r["p"] == "family")
    known = known_given | known_family

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            total, mailed, plain = Counter(), Counter(), Counter()
            for table, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not (text := text.as_py()):
                    continue
                values = formed(text)
                for s, e, kind in values:
                    out.append(("value", table, item, kind, s, e, None, None, None, None, None, None, None))
                    if kind == "email":
                        mailed.update(mailbox_terms(text[s:e]))
                terms, found = frames(text)
                total.update(terms)
                for s, e, given, family in found:
                    if given in TITLES or family in TITLES or any(s < e2 and e > s2 for s2, e2, _ in values):
                        continue
                    g, f = given is None or given in known_given, family in known_family
                    out.append(("frame", table, item, None, s, e, given, family, g, f, context(text, s), None, None))
                words = [w for w in _WORD.findall(text) if w in known]
                if words:
                    plain.update(words)
                    # in an email address a name is no other word
                    plain.subtract(w for s, e, kind in values if kind == "email" for w in _WORD.findall(text[s:e]) if w in known)
                    if not known_family.isdisjoint(words) and not known_given.isdisjoint(words):
                        at = 0
                        while m := _LOWER.search(text, at):
                            at = m.start(3)
                            given, family = (m[3], m[1]) if m[2] == ", " else (m[1], m[3])
                            if given in known_given and family in known_family and all(m.end() <= s or m.start() >= e for s, e, _ in values):
                                out.append(("lower", table, item, None, m.start(), m.end(), given, family, True, True, None, None, None))
            out.extend(("plain", None, None, None, None, None, t, None, None, None, None, n, None) for t, n in plain.items() if n > 0)
            for t in total.keys() | mailed.keys():
                out.append(("term", None, None, None, None, None, t, None, t in known_given, t in known_family, None, total[t], mailed[t]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], [n for n, _ in _FIELDS])

    source = spread(items.select("item_table", F.col("item_id").cast("bigint"), "text").filter("text is not null"))
    return source.mapInArrow(run, _DDL)


def revealing(scanned: DataFrame) -> DataFrame:
    """`context, reveals`: words before frames, and the share of known persons among those frames."""
    per = scanned.filter("what = 'frame'").groupBy("context").agg(
        F.sum(F.when(F.col("is_given") & F.col("is_family"), 1).otherwise(0)).alias("persons"), F.count(F.lit(1)).alias("all")
    )
    return per.filter((F.col("persons") >= 2) & (F.col("persons") >= LEAST_CONTEXT * F.col("all"))).select(
        "context", (F.col("persons") / F.col("all")).alias("reveals")
    )


def disclosure(scanned: DataFrame) -> DataFrame:
    """`term, part, in_lexicon, n, share, bits` of every term in a name frame, by part of the name.

    Bits are the mutual information of the term and a person: of the share of its occurrences
    that reveal one, over that share for all terms outside the lexicon. A term may be both parts.
    """
    frames_ = scanned.filter("what = 'frame'").join(revealing(scanned), "context", "left")
    reveals = F.coalesce("reveals", F.lit(0.0))
    known = F.col("is_given") & F.col("is_family")
    part = lambda c, name, own: F.struct(
        F.col(c).alias("term"), F.lit(name).alias("part"), F.col(own).alias("in_lexicon"), F.when(F.col(own) & known, 1.0).otherwise(reveals).alias("w")
    )
    parts = F.array(F.when(F.col("given").isNotNull(), part("given", "given", "is_given")), part("family", "family", "is_family"))
    worth = (
        frames_.select(F.explode(F.array_compact(parts)).alias("x"))
        .groupBy("x.term", "x.part", "x.in_lexicon")
        .agg(F.sum("x.w").alias("worth"), F.count(F.lit(1)).alias("framed"))
    )
    seen = scanned.filter("what = 'term'").groupBy(F.col("given").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("n_mail").alias("mail"), F.bool_or(F.col("is_given") | F.col("is_family")).alias("listed")
    )
    told = F.col("worth") + F.when(F.col("listed"), 0).otherwise(F.least("mail", "framed"))
    both = worth.join(seen, "term").withColumn("told", told)
    # one row each; what is usual is so of terms of which nothing is known beforehand
    others = both.filter("not listed").agg(F.sum("told").alias("all_told"))
    whole = others.join(seen.filter("not listed").agg(F.sum("n").alias("all_n"))).select(F.try_divide("all_told", "all_n").alias("usual"))
    share = F.least(F.lit(1.0), F.try_divide(F.col("told"), F.col("n")))
    bits = F.log2(share / F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1e-9)))
    return both.filter("told > 0").join(F.broadcast(whole)).select("term", "part", "in_lexicon", "n", share.alias("share"), bits.alias("bits"))


def disclosing(terms: DataFrame) -> DataFrame:
    """Of the result of `disclosure` the terms above the thresholds."""
    return terms.filter((F.col("share") >= LEAST_SHARE) & (F.col("bits") >= LEAST_BITS))


def small_letters(scanned: DataFrame) -> DataFrame:
    """Persons written in small letters: a pair of which one name hardly occurs but in such pairs.

    Some names are also words (`mark`, `branch`): a pair of two such words is none.
    """
    pairs = scanned.filter("what = 'lower'")
    counted = pairs.select(F.explode(F.array("given", "family")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("paired"))
    plain = scanned.filter("what = 'plain'").groupBy(F.col("given").alias("term")).agg(F.sum("n").alias("n"))
    rare = counted.join(plain, "term").filter("paired >= 0.5 * n").select("term")
    named = pairs.join(rare.select(F.col("term").alias("given"), F.lit(True).alias("a")), "given", "left")
    named = named.join(rare.select(F.col("term").alias("family"), F.lit(True).alias("b")), "family", "left")
    return named.filter("a or b").select("item_table", "item_id", "start_char", "end_char", "given", "family")


def persons(scanned: DataFrame, told: DataFrame) -> DataFrame:
    """Frames and pairs in small letters that are persons, with the bits that their parts disclose (null below the thresholds)."""
    given = told.filter("part = 'given'").groupBy(F.col("term").alias("given")).agg(F.max("bits").alias("given_bits"))
    family = told.filter("part = 'family'").groupBy(F.col("term").alias("family")).agg(F.max("bits").alias("family_bits"))
    columns = ["item_table", "item_id", F.lit("person_name").alias("pii_type"), "start_char", "end_char", "given", "family", "given_bits", "family_bits"]
    rows = scanned.filter("what = 'frame'").join(given, "given", "left").join(family, "family", "left")
    framed = rows.filter("(is_given or given_bits is not null) and (is_family or family_bits is not null) and coalesce(given_bits, family_bits) is not null")
    lower = small_letters(scanned).join(given, "given", "left").join(family, "family", "left")
    return framed.select(*columns).unionByName(lower.select(*columns))


def spans(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every occurrence of personal information: `item_table, item_id, pii_type, start_char, end_char`.

    Offsets count code points from zero. Null and empty texts have none; equal rows of `items`
    give one occurrence; an empty lexicon leaves names unfound. Of overlapping names the one
    that starts first stays.
    """
    scanned = cut(scan(items, lexicon))
    return _spans(scanned, persons(scanned, cut(disclosing(disclosure(scanned)))))


def _spans(scanned: DataFrame, people: DataFrame) -> DataFrame:
    # frames of one text that share a term: the later one would claim a part of the earlier
    per_text = people.groupBy("item_table", "item_id", "pii_type").agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("all"))
    free = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start_char:bigint,end_char:bigint>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start_char"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end_char"], F.lit(0))), done
        ).otherwise(F.array_append(done, x)),
    )
    names = per_text.select("item_table", "item_id", "pii_type", F.explode(free).alias("x")).select("item_table", "item_id", "pii_type", "x.start_char", "x.end_char")
    values = scanned.filter("what = 'value'").select("item_table", "item_id", F.col("kind").alias("pii_type"), "start_char", "end_char")
    return values.distinct().unionByName(names)


def redact(items: DataFrame, found: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """`item_table, item_id, text, n_replaced, n_terms`: each span of `found` replaced by `[TYPE]`.

    `terms` (`item_table, item_id, term`) are words in lower case that would still reveal a person of
    the item: where one stands alone with a capital it becomes `[NAME]`, counted by `n_terms`. Texts
    without a span come back as they are. (item_table, item_id) is unique in `items`. Texts are
    shuffled only if the spans are too many to be sent to every task.
    """
    keys = ["item_table", "item_id"]
    marks = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char", "pii_type"))).alias("marks"))
    fits = small(found)
    if terms is None:
        marks = marks.withColumn("terms", F.lit(None).cast("array<string>"))
    else:
        marks = marks.join(terms.groupBy(*keys).agg(F.collect_set("term").alias("terms")), keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lone = [], [], []
            for text, spans_, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                n = 0
                if spans_ and text:
                    known = frozenset(words or ())

                    def plain(part: str) -> str:
                        nonlocal n
                        if not known:
                            return part
                        n += sum(m[0].lower() in known for m in _TERM.finditer(part))
                        return _TERM.sub(lambda m: "[NAME]" if m[0].lower() in known else m[0], part)

                    parts, at = [], 0
                    for x in spans_:
                        if x["start_char"] >= at:
                            parts += [plain(text[at : x["start_char"]]), f"[{x['pii_type'].upper()}]"]
                            at = x["end_char"]
                    text = "".join([*parts, plain(text[at:])])
                texts.append(text)
                counts.append(len(spans_ or ()))
                lone.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(lone, pa.int32())], [*keys, "text", "n_replaced", "n_terms"]
            )

    source = items.select("item_table", F.col("item_id").cast("bigint"), "text").join(F.broadcast(marks) if fits else marks, keys, "left")
    return source.mapInArrow(run, "item_table string, item_id bigint, text string, n_replaced int, n_terms int")


def redacted(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`redact` with all that `spans` finds, and with the terms of each item's persons that disclose above the thresholds."""
    scanned = cut(scan(items, lexicon))
    people = cut(persons(scanned, cut(disclosing(disclosure(scanned)))))
    told = F.array_compact(F.array(F.when(F.col("given_bits").isNotNull(), F.col("given")), F.when(F.col("family_bits").isNotNull(), F.col("family"))))
    terms = people.select("item_table", "item_id", F.explode(told).alias("term")).distinct()
    return redact(items, cut(_spans(scanned, people)), terms)


def items_of(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of normalized events and search chunks as `item_table, item_id, text`."""
    return events.select(F.lit("normalized_events").alias("item_table"), F.col("event_id").alias("item_id"), "text").unionByName(
        chunks.select(F.lit("search_chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), "text")
    )
