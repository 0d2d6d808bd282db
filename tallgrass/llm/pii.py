"""Personal data and secrets by rules and by weak supervision, in DataFrame functions only.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers. Broader patterns find candidates: numbers
of nine digits or more, addresses written with "(at)" or "(dot)", names after a title or with a frequent given name,
keys and passwords, bank account numbers (IBAN), and street addresses. Labelers vote on each candidate (1 personal, -1
not, 0 no opinion):

* regex: the form is that of a phone, card, social security number, key or address; or of a date, a version, a decimal number
* checksum: Luhn for numbers of 12 to 19 digits, modulo 97 for IBANs
* gazetteer: dialling codes and card prefixes for numbers, given names for names, top-level domains for addresses,
  countries for IBANs; for keys the variety of characters
* context before: words such as "call", "card" or "token"; or "page", "price", "commit"
* length: in the range of phones, cards and keys

Expectation-maximisation over the counts of vote patterns (3^5 for each family at most, whatever the input's size)
estimates how reliable each labeler is and how probable each pattern. These probabilities train the final classifier,
a logistic regression on what the span itself looks like and what stands before it (see shape), not on the votes, by
gradient steps over counts of equal rows. Spans that it finds probable are added where they do not overlap a rule's span.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import written

KINDS = ("email", "ip", "card", "phone", "number", "address", "name", "secret", "iban", "street")
#: The first four kinds. Runs are possessive and start where a run starts (or where the last match ended), which finds
#: the same matches as the plain patterns in linear time and constant stack.
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
RULES = (
    (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    (r"[0-9](?:[\x20-]?[0-9])++", lambda m: _n_digits(m).between(12, 19) & F.call_function("luhn_check", F.translate(m, " -", ""))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _n_digits(m).between(9, 15)),
)
#: Given names, of which a name without a title has one.
GIVEN_NAMES = "Ana Anna Carlos Charles Claire David Elena Emma Hans Ines James Jan Javier Jean John Jose Juan Julia Karl Klaus Laura Linda Lucia Luis Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Sofia Thomas William".split()
_STREET = "(?:[A-ZÄÖÜ][a-zäöüß]{2,30}(?:[Ss]tra(?:ß|ss)e|weg|platz|allee)\\x20[0-9]{1,4}+|[0-9]{1,5}+\\x20[A-Z][a-z]++\\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)\\b|[0-9]{1,4}+,?\\x20(?:rue|avenue|boulevard)\\x20(?:de\\x20)?[A-Z][a-zà-ÿ]++|(?:Calle|Avenida)\\x20[A-Z][a-zà-ÿ]++\\x20[0-9]{1,4}+)"
#: Candidates of the kinds behind the first four, which may contain matches of the rules.
BROAD = (
    (r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++(?![0-9A-Za-z])", lambda m: _n_digits(m) >= 9),
    (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++", None),
    (rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?+|(?:{'|'.join(GIVEN_NAMES)})\x20[A-Z][a-z]++)", None),
    (r"(?<![A-Za-z0-9+/_-])(?:(?i:password|passwd|passwort|pwd)\x20?[:=]\x20?[\"']?[^\s\"']{4,64}+|[A-Za-z0-9+/_-]{16,}+={0,2}+)", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None),
    (rf"(?<![0-9A-Za-zÄÖÜäöüß]){_STREET}", None),
)
#: Fixed values of the labelers.
DIALLING = r"^\+?\(?(?:1|7|20|27|30|31|32|33|34|36|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIX = r"^\+?\(?(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
FOR = r"(?i)(?:phone|tel|call|mobile|fax|card|account|konto|iban|contact|mail|email|e-mail|ssn|passport|reach|address|adresse|token|secret|api[ _-]?key|key|auth|bearer|credential|pass(?:word|wort)?)[\s:.#=(\"']*(?:\S+\s+)?$"
AGAINST = r"(?i)(?:page|pages|isbn|issn|version|price|total|sum|usd|eur|\$|€|id|order|item|hash|sha1|sha256|md5|commit|revision|checksum|digest|uuid|year)[\s:.#=(\"']*$"
OWN_WORD = r"^(?i:pass|pwd)"
TITLE = r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b"
SECRET_SHAPE = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-.+|eyJ[A-Za-z0-9_-]{10,}.*|(?i:pass|pwd).*)$"
NO_SECRET_SHAPE = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|/.*/|^[0-9-]+$|^(?:[a-z]+[_-])+[a-z0-9]+$"
IBAN_COUNTRY = r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
PHONE_SHAPE = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\+|^\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$"
CARD_SHAPE = r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"
OTHER_SHAPE = r"^[0-9]+\.[0-9]+$|^[0-9]{4}-[0-9]{2}-[0-9]{2}|\.[0-9]+\.[0-9]+\.[0-9]+\."
VOTES = ("regex", "checksum", "gazetteer", "context", "length")
#: P(vote -1, 0, 1) of each labeler for what is not personal and what is: a failed checksum speaks most clearly.
_FAIR = ({-1: 0.5, 0: 0.3, 1: 0.2}, {-1: 0.2, 0: 0.3, 1: 0.5})
START = {"regex": _FAIR, "checksum": ({-1: 0.6, 0: 0.38, 1: 0.02}, {-1: 0.005, 0: 0.495, 1: 0.5}), "gazetteer": _FAIR, "context": ({-1: 0.2, 0: 0.75, 1: 0.05}, {-1: 0.02, 0: 0.78, 1: 0.2}), "length": _FAIR}
CONTEXT = 40  # code points before a candidate


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


STEP = 1000  # matches that are put together at once


def _spans(text: Column, kind: int, pattern: str, valid: Callable[[Column], Column] | None) -> Column:
    """Valid matches as an array of (start, kind, end, value, before): leftmost, not overlapping, in code points.

    The pieces between the matches and the matches themselves, in turn, give the places. They are added up in parts,
    so that a text of very many matches does not grow one array match by match.
    """
    empty = F.array().cast("array<struct<start: int, kind: int, end: int, value: string, before: string>>")
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        near = F.when(F.length(x["between"]) >= CONTEXT, F.substring(x["between"], -CONTEXT, CONTEXT)).otherwise(x["between"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("value"), near.alias("before")))
        ok = x["found"].isNotNull() if valid is None else x["found"].isNotNull() & valid(x["found"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(ok, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def moved(s: Column, part: Column) -> Column:
        own = F.transform(part["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + s["at"]).alias("end"), x["value"].alias("value"), x["before"].alias("before")))
        return F.struct((s["at"] + part["at"]).alias("at"), F.concat(s["out"], own).alias("out"))

    def whole(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STEP).cast("int")), lambda i: F.aggregate(F.slice(z, i * STEP + 1, F.lit(STEP)), start, step))
        return F.aggregate(parts, start, moved, lambda s: s["out"])

    pieces = F.arrays_zip(found.alias("found"), between.alias("between"))
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(pieces), whole), 0)).otherwise(empty)


def _mod97(value: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.translate(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: ((a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97).cast("int")) == 1


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def shape(c: Column) -> dict[str, Column]:
    """What the final classifier sees of a candidate: small numbers that describe the span and what stands before it."""
    value, before = c["value"], c["before"]
    has = lambda p: value.rlike(p).cast("int")
    n = F.length(value)
    return {
        "size": F.when(n < 10, 0).when(n < 14, 1).when(n < 20, 2).when(n < 34, 3).when(n < 66, 4).otherwise(5),
        "marks": has(r"\x20") + 2 * has("-") + 4 * has(r"\.") + 8 * has(r"[()@+\[]") + 16 * has("[/_=:]"),
        "letters": has("[a-zß-ÿ]") + 2 * has("[A-Z]"),
        "digits": F.floor(4 * _n_digits(value) / F.greatest(n, F.lit(1))).cast("int"),
        "variety": F.least(F.lit(5), F.floor(_variety(value) / 3)).cast("int"),
        "edge": F.when(before == "", 0).when(before.rlike(r"[\"'=:]\s*$"), 1).when(before.rlike(r"\d\S*\s*$"), 2).when(before.rlike(r"[A-Za-zß-ÿ]\s+$"), 3).otherwise(4),
        "word": F.when(before.rlike(FOR) | (c["kind"] == 7) & value.rlike(OWN_WORD), 1).when(before.rlike(AGAINST), 2).otherwise(0),
    }


SHAPES = ("size", "marks", "letters", "digits", "variety", "edge", "word")


def votes(c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate."""
    value, digits, kind = c["value"], F.regexp_replace(c["value"], "[^0-9]", ""), c["kind"]
    n, size, number, address, name, secret, iban = F.length(digits), F.length(value), kind == 4, kind == 5, kind == 6, kind == 7, kind == 8
    pick = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    never = F.lit(False)
    names = F.array(*map(F.lit, GIVEN_NAMES))
    known = F.arrays_overlap(F.split(value, " "), names)
    luhn = F.call_function("luhn_check", digits)
    return {
        "regex": F.when(number, pick(value.rlike(PHONE_SHAPE) | value.rlike(CARD_SHAPE), value.rlike(OTHER_SHAPE))).when(name, pick(value.rlike(TITLE) | known, never)).when(secret, pick(value.rlike(SECRET_SHAPE), value.rlike(NO_SECRET_SHAPE))).otherwise(F.lit(1)),
        "checksum": F.when(number & n.between(12, 19), pick(luhn, ~luhn)).when(iban, pick(_mod97(value), ~_mod97(value))).otherwise(0),
        "gazetteer": F.when(number, pick(value.rlike(DIALLING) | value.rlike(CARD_PREFIX), never)).when(name, pick(known, ~known)).when(address, pick(value.rlike(DOMAINS), ~value.rlike(DOMAINS))).when(iban, pick(value.rlike(IBAN_COUNTRY), ~value.rlike(IBAN_COUNTRY))).when(secret, pick(_variety(value) >= 10, _variety(value) < 7)).otherwise(F.lit(1)),
        "context": pick(c["before"].rlike(FOR) | secret & value.rlike(OWN_WORD), c["before"].rlike(AGAINST)),
        "length": F.when(number, pick(n.between(9, 11) | n.between(13, 16), n > 19)).when(secret, pick(size.between(20, 128), size > 256)).when(iban, pick(F.length(F.translate(value, " ", "")).between(15, 34), never)).otherwise(0),
    }


def fit_labelers(counts: dict[tuple, float], rounds: int = 50, prior: float = 0.5, hold: float = 20.0) -> dict[tuple, float]:
    """P(personal) of each (family, votes) pattern by expectation-maximisation.

    counts: documents' candidates by pattern. Each family has its own share of personal candidates; labelers have their
    reliabilities in common, to which no family adds more than the median one has, so that a large family does not decide
    for the others. Shares and reliabilities start at prior and START with
    the weight of ``hold`` candidates, whatever the number of candidates: a few give no certainty, and many overrule the
    start, also of a labeler that is mostly wrong.
    """
    families = {f: sum(c for p, c in counts.items() if p[0] == f) for f in {p[0] for p in counts}}
    middle = sorted(families.values())[len(families) // 2] if families else 0
    weight = {f: min(1.0, max(middle, hold) / n) for f, n in families.items()}
    table = {(y, k, v): START[name][y][v] for y in (0, 1) for k, name in enumerate(VOTES) for v in (-1, 0, 1)}
    share, post = dict.fromkeys(families, prior), {}
    for _ in range(rounds):
        for p in counts:
            a, b = share[p[0]], 1 - share[p[0]]
            for k, v in enumerate(p[1:]):
                a, b = a * table[1, k, v], b * table[0, k, v]
            post[p] = a / (a + b)
        for f, n in families.items():
            share[f] = (sum(c * post[p] for p, c in counts.items() if p[0] == f) + hold * prior) / (n + hold)
        for y in (0, 1):
            for k in range(len(VOTES)):
                n = {v: hold * START[VOTES[k]][y][v] for v in (-1, 0, 1)}
                for p, c in counts.items():
                    n[p[1 + k]] += c * weight[p[0]] * (post[p] if y else 1 - post[p])
                total = sum(n.values())
                table |= {(y, k, v): n[v] / total for v in n}
    return post


def fit_classifier(rows: dict[tuple, float], rounds: int = 400, ridge: float = 1e-3) -> dict[tuple, float]:
    """Logistic regression on rows (family, P(personal), shape...) with their counts: weights of (family, feature, value)."""
    features = {p: [(p[0], "family", 0), *((p[0], k, v) for k, v in zip(SHAPES, p[2:]))] for p in rows}
    weights, total = dict.fromkeys({f for x in features.values() for f in x}, 0.0), {}
    for p, c in rows.items():
        total[p[0]] = total.get(p[0], 0.0) + c
    square = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {f: -ridge * w for f, w in weights.items()}
        for p, c in rows.items():
            z = sum(weights[f] for f in features[p])
            g = c / total[p[0]] * (p[1] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for f in features[p]:
                slope[f] += g
        for f, g in slope.items():
            square[f] += g * g
            weights[f] += 0.5 * g / math.sqrt(square[f])
    return weights


def find(docs: DataFrame, sure: float = 0.9) -> DataFrame:
    """documents -> doc_id, base and added: arrays of (start, kind, end), in order.

    Kinds are places in KINDS. A null text is empty, an empty one has no spans; repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored. A span with just the odds asked for is not added; of candidates of
    two kinds that overlap both may be added.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.flatten(F.array(*[_spans(text, k, p, ok) for k, (p, ok) in enumerate(RULES)]))
    broad = F.flatten(F.array(*[_spans(text, 4 + k, p, ok) for k, (p, ok) in enumerate(BROAD)]))
    plain = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    voted = F.transform(broad, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), *[v.cast("int").alias(k) for k, v in (votes(c) | shape(c)).items()]))
    seen = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(base).alias("base"), voted.alias("broad")), "candidates")
    # as many rows as there are combinations of votes and shapes, whatever the input's size
    rows = seen.select(F.explode("broad").alias("c")).select("c.*").groupBy("kind", *VOTES, *SHAPES).count().collect()
    counts: dict[tuple, float] = {}
    for r in rows:
        counts[r["kind"], *[r[v] for v in VOTES]] = counts.get((r["kind"], *[r[v] for v in VOTES]), 0.0) + r["count"]
    post, spans = fit_labelers(counts), {}
    for r in rows:
        p = (r["kind"], post[r["kind"], *[r[v] for v in VOTES]], *[r[k] for k in SHAPES])
        spans[p] = spans.get(p, 0.0) + r["count"]
    weights = fit_classifier(spans)

    def score(c: Column) -> Column:
        z = F.lit(0.0)
        for k in range(4, len(KINDS)):
            own = [(name, value, w) for (kind, name, value), w in sorted(weights.items()) if kind == k]
            part = F.lit(0.0)
            for name, value, w in own:
                part = part + (F.lit(w) if name == "family" else F.when(c[name] == value, w).otherwise(0.0))
            z = F.when(c["kind"] == k, part).otherwise(z) if own else z
        return z

    apart = lambda c, s: (c["end"] <= s["start"]) | (s["end"] <= c["start"])
    added = F.filter("broad", lambda c: (score(c) > math.log(sure / (1 - sure))) & F.forall("base", lambda s: apart(c, s)))
    return seen.select("doc_id", "base", plain(added).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_spans, the number of all spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return find(docs).select("doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
