"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are the fixed patterns of KINDS with their checks. Other spans are
candidates that no fixed pattern accepts: spelled-out mail addresses, telephone
numbers without a country, addresses of IP version 6. Candidates and base spans
alike are looked at by labelers of three kinds, each of which votes for or
against or abstains:

* regex labelers look at the span's form,
* gazetteer labelers at lists (top-level domains, calling codes, card issuers),
* context labelers at the words before it.

Expectation-maximisation over all votes finds how often each labeler votes which
way on true and on false spans (a Dawid-Skene model with abstentions), per kind.
Spans with the same votes are counted together first, so the model's input is a
row for each pattern of votes, whose number does not grow with the corpus. The
posterior of each pattern then teaches the span classifier: a logistic
regression over features of form and context, fitted by gradient steps on
counted feature patterns. Both fits are folds over one array, in Spark. A
candidate becomes a span if the classifier's probability is ACCEPT or more; base
spans stay whatever it says.

Positions come from splitting a text by a pattern: the pieces between matches
and the matches alternate, so their running lengths are the matches' places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ACCEPT = 0.9
EM_STEPS, GRADIENT_STEPS, RATE, RIDGE = 30, 300, 0.5, 1e-4
# votes (against, abstaining, for) added to the counts of those on true and on false spans: labelers are better than chance
TRUE_VOTES, FALSE_VOTES = (0.5, 2.0, 4.0), (4.0, 2.0, 0.5)
CHUNK = 512         # matches whose places are summed up in one array
BEFORE = 32         # code points before a span that the context labelers read
LONGEST = 64        # code points of a span that its labelers and features read

# fixed values: the base kinds, in their order. A run starts where the last match ended or where no character of the
# run stands before it, and is taken whole: the same matches as without both, in time linear in the text
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
# what else may be personal: forms that the base patterns leave out
CANDIDATES = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?)[A-Za-z0-9-]{{1,63}}+"
             r"(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.(/-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20./-][0-9]{2,4}){2,4}+(?![0-9.-])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
}
# fixed values: lists of the gazetteer labelers
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at", "nl", "be", "pl", "se", "ca", "au", "jp", "cn", "in", "br", "mx", "ru")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|4[4-9]|5)|35|62)"


@dataclass(frozen=True)
class Labeler:
    """A vote on spans of some kinds: SQL conditions over span (the text),
    digits (its digits) and before (the text before it, lowered)."""

    name: str
    kinds: tuple[str, ...]
    yes: str = "false"
    no: str = "false"


def _words(*words: str) -> str:
    return "regexp_like(before, r'(?:^|[^a-z])(?:" + "|".join(words) + r")[^0-9a-z]{0,3}(?:[a-z]{1,12}[^0-9a-z]{1,3}){0,2}$')"


def _one_of(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


LABELERS = (
    # form
    Labeler("email_shape", ("email",), r"regexp_like(span, r'^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$')", r"regexp_like(span, r'\.\.|@-|-@|[\[(]')"),
    Labeler("ip_shape", ("ip",), r"regexp_like(span, r'^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$')", r"regexp_like(span, r'(?:^|\.)0[0-9]')"),
    Labeler("card_shape", ("card",), r"regexp_like(span, r'^[0-9]{14,19}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$')", r"not regexp_like(span, r'[\x20-][0-9]{4,}|^[0-9]+$')"),
    Labeler("phone_shape", ("phone",), r"regexp_like(span, r'^\+[0-9]{1,3}[\x20.-]?\(?[0-9]')", r"regexp_like(span, r'^(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}$|^[0-9]{2}[./-][0-9]{2}[./-](?:19|20)?[0-9]{2}$')"),
    Labeler("phone_digits", ("phone",), "length(digits) between 10 and 13", "length(digits) < 9 or length(digits) > 15"),
    Labeler("same_digits", ("card", "phone", "ip"), "false", "regexp_like(digits, r'^([0-9])\\1+$')"),
    # lists
    Labeler("top_level", ("email",), f"lower(regexp_extract(span, r'[.\\x20\\])]([A-Za-z-]+)$', 1)) in {_one_of(TOP_LEVEL)}", r"regexp_like(span, r'[0-9-]$')"),
    Labeler("calling_code", ("phone",), f"startswith(span, '+') and (substr(digits, 1, 1) in {_one_of(CALLING_CODES)} or substr(digits, 1, 2) in {_one_of(CALLING_CODES)})", "startswith(digits, '0000')"),
    Labeler("issuer", ("card",), f"regexp_like(digits, r'{ISSUERS}')", "startswith(digits, '0') or startswith(digits, '9')"),
    Labeler("address_range", ("ip",), r"not regexp_like(span, r'^(?:0|127|22[4-9]|2[3-5][0-9])\.')", r"regexp_like(span, r'^0\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$')"),
    # context
    Labeler("contact_words", ("email", "phone"), _words("e-?mail", "mail", "contact", "write", "reach", "correo", "courriel", "kontakt", "contacto"), _words("version", "isbn", "issn", "release")),
    Labeler("phone_words", ("phone",), _words("tel", "phone", "telefon", "telephone", "t.l.phone", "tel.fono", "call", "mobile", "cell", "fax", "handy", "mobil"), _words("date", "page", "no", "order", "invoice", "chapter", "pp?")),
    Labeler("card_words", ("card",), _words("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"), _words("isbn", "order", "serial", "invoice", "id", "tracking")),
    Labeler("ip_words", ("ip",), _words("ip", "address", "host", "server", "from", "adresse"), _words("version", "v", "ver", "release", "section", "chapter", "build")),
)
# features of the classifier: form and context, read apart from the labelers' votes
FEATURES = (
    "1 = 1", "length(span) >= 12", "length(span) >= 17", "length(digits) >= 10", "length(digits) >= 14", "startswith(span, '+')",
    "contains(span, '@')", r"regexp_like(span, r'[\[(]\x20?(?i:at|dot)')", r"regexp_like(span, r'^[0-9]+(?:\.[0-9]+){3}$')", "contains(span, ':')",
    r"regexp_like(span, r'(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)')", r"regexp_like(before, r'[:=]\x20?$')",
    r"regexp_like(before, r'(?:tel|phone|fon|call|fax|mobil|cell|mail|contact|kontakt|card|karte|visa|carte|tarjeta|ip|host|server)[^0-9]{0,24}$')",
    r"regexp_like(before, r'(?:version|release|isbn|page|date|order|invoice|chapter|section|serial)[^0-9]{0,24}$')",
)


# ---- spans

_SPAN = "struct<kind:string,base:boolean,start:int,end:int,span:string,before:string>"


def found(text: Column, kind: str, pattern: str, hint: Column, base: bool) -> Column:
    """array<_SPAN> of a pattern's matches that pass the kind's check, in order;
    ``hint`` is true of every text that has a match. Matches are walked in
    chunks, so that many in one text stay linear."""
    none = F.array().cast(f"array<{_SPAN}>")
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda s, g: F.struct(
        F.length(g).alias("gap"), F.length(s).alias("width"), s.alias("span"), F.lower(F.right(g, F.lit(BEFORE))).alias("before")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), start.alias("start"), (start + x["width"]).alias("end"),
                        F.left(x["span"], F.lit(LONGEST)).alias("span"), x["before"].alias("before"))
        good = x["span"].isNotNull() & (passes(kind, x["span"]) if base else F.lit(True))
        return F.struct((start + F.coalesce(x["width"], F.lit(0))).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(walked), lambda w: F.struct(w["at"].alias("at"), F.concat(acc["out"], F.array(w["out"])).alias("out")))[0]

    def walk(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")), chunk)["out"])

    return F.when(hint, F.transform(F.array(pairs), walk)[0]).otherwise(none)  # pairs are worked out once


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, span: Column) -> Column:
    """A base kind's check of a match."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return span.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.transform(F.array(digits_of(span)), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))[0]
    if kind == "phone":
        return F.length(digits_of(span)).between(10, 15)
    return F.lit(True)


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans): base spans and candidates of every row; written
    out, so that a row keeps its number."""
    text = F.coalesce("text", F.lit(""))
    hints = {"email": text.contains("@"), "ip": text.contains("."), "phone": text.contains("+"), "card": text.rlike("[0-9][\\x20-]?[0-9]")}
    more = {"email": text.rlike(r"[\[(]\x20?[aA][tT]\x20?[\])]"), "phone": text.rlike(r"[0-9]\)?[\x20./-][0-9]"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")}
    spans = [found(text, k, PATTERNS[k], hints[k], True) for k in KINDS] + [found(text, k, p, more[k], False) for k, p in CANDIDATES.items()]
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*spans).alias("spans")))


def span_rows(scan: DataFrame) -> DataFrame:
    """(row, kind, base, start, end, span, before, digits): a row a span. Of the
    candidates those that touch no base span of their text."""
    rows = scan.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    ahead = Window.partitionBy("row").orderBy("start", F.desc("base"))
    behind = Window.partitionBy("row").orderBy(F.desc("end"), F.desc("base"))
    reach, next_start = F.max(F.when(F.col("base"), F.col("end"))).over(ahead), F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    rows = rows.withColumns({"reach": reach, "next_start": next_start})
    free = (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("next_start") >= F.col("end"), F.lit(True)))
    return rows.where(F.col("base") | free).drop("reach", "next_start").withColumn("digits", digits_of(F.col("span")))


# ---- weak supervision


def votes() -> Column:
    """A span's votes: 1, -1 or 0 for each labeler, which abstains on other kinds."""
    return F.array(*[F.when(~F.col("kind").isin(*x.kinds), 0).when(F.expr(x.yes), 1).when(F.expr(x.no), -1).otherwise(0) for x in LABELERS])


def once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once."""
    return F.transform(F.array(value), use)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def expectation_maximisation(patterns: Column, steps: int = EM_STEPS) -> Column:
    """P(true) of each of ``patterns``, an array<struct<votes, n>>: in turn, how
    often each labeler votes which way on true and on false spans, weighted by
    the present posteriors, and the posteriors that follow. Starts from the sums
    of votes."""
    sigmoid = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    start = F.transform(patterns, lambda p: sigmoid(total(F.transform(p["votes"], lambda v: v.cast("double")))))
    true_votes, false_votes = (F.array(*[F.lit(x) for x in xs]) for xs in (TRUE_VOTES, FALSE_VOTES))

    def step(q: Column, _: Column) -> Column:
        n1 = F.zip_with(patterns, q, lambda p, x: p["n"] * x)
        n0 = F.zip_with(patterns, q, lambda p, x: p["n"] * (F.lit(1.0) - x))

        def logs(counts: Column, prior: Column) -> Column:
            def labeler(m: Column) -> Column:
                by_vote = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: total(F.zip_with(patterns, counts, lambda p, c: F.when(p["votes"][m] == v, c).otherwise(0.0))))
                return once(F.zip_with(by_vote, prior, lambda c, x: c + x), lambda cs: F.transform(cs, lambda c: F.log(c / total(cs))))
            return F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), labeler)

        def posterior(w: Column) -> Column:
            return F.transform(patterns, lambda p: sigmoid(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), w["prior"] + total(F.zip_with(
                p["votes"], F.zip_with(w["l1"], w["l0"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v, l: l["a"][v + 1] - l["b"][v + 1]))))))

        weights = once(F.struct(n1.alias("n1"), n0.alias("n0")), lambda c: F.struct(
            logs(c["n1"], true_votes).alias("l1"), logs(c["n0"], false_votes).alias("l0"),
            (F.log(total(c["n1"]) + 1.0) - F.log(total(c["n0"]) + 1.0)).alias("prior")))
        return once(weights, posterior)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def posteriors(voted: DataFrame) -> DataFrame:
    """(kind, votes, q) for every pattern of votes on rows (kind, votes, ...);
    the patterns, at most 3 to the number of a kind's labelers, are all that is
    put together."""
    counts = voted.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    solved = patterns.select("kind", "patterns", expectation_maximisation(F.col("patterns")).alias("q"))
    return solved.select("kind", F.explode(F.arrays_zip("patterns", "q")).alias("x")).select("kind", F.col("x.patterns.votes").alias("votes"), F.col("x.q").alias("q"))


def features() -> Column:
    return F.array(*[F.coalesce(F.expr(x), F.lit(False)).cast("int") for x in FEATURES])


def classifier(taught: DataFrame, steps: int = GRADIENT_STEPS) -> DataFrame:
    """One row (weights): the logistic regression of q on the features of rows
    (features, q), fitted on counted feature patterns."""
    counts = taught.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("q").alias("q"))
    patterns = counts.agg(F.sort_array(F.collect_list(F.struct("features", "n", "q"))).alias("patterns"))
    all_rows = total(F.transform("patterns", lambda p: p["n"]))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(F.col("patterns"), lambda p: F.struct(p["features"].alias("x"), (p["q"] - p["n"] * probability(w, p["features"])).alias("e")))
        return once(F.struct(errors.alias("errors"), all_rows.alias("n")), lambda c: F.transform(w, lambda x, i: x * (1 - RATE * RIDGE) + F.lit(RATE) * total(
            F.transform(c["errors"], lambda r: F.when(r["x"][i] == 1, r["e"]).otherwise(0.0))) / F.greatest(c["n"], F.lit(1.0))))

    zeros = F.array(*[F.lit(0.0)] * len(FEATURES))
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zeros, step).alias("weights"))


def probability(weights: Column, x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total(F.zip_with(weights, x, lambda w, v: w * v))))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of spans with q, the posterior of their votes, and p, the
    classifier's probability. The posteriors and the weights that are joined to
    the rows are bounded by the labelers and features, not by the corpus."""
    voted = stored(rows.withColumns({"votes": votes(), "features": features()}))
    taught = voted.join(F.broadcast(posteriors(voted)), ["kind", "votes"])
    weights = stored(classifier(taught.select("features", "q")))
    return taught.crossJoin(F.broadcast(weights)).withColumn("p", probability(F.col("weights"), F.col("features"))).drop("weights", "votes", "features")


def spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found): for every row of ``docs`` its spans, an array of
    (start, place of the kind in KINDS, end, kind, base, p) in that order; p is
    the classifier's probability, which decides on the spans that are not base.

    A null text is empty and has no span; rows that repeat have the same spans;
    other columns are not read. Places are code points, ends exclusive."""
    scan = scanned(docs)
    held = judged(span_rows(scan)).where(F.col("base") | (F.col("p") >= ACCEPT))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    by_row = held.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base", "p"))).alias("found"))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,base:boolean,p:double>>")
    return scan.select("row", "doc_id").join(by_row, "row", "left").withColumn("found", F.coalesce("found", none))


def spelled(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row
    of ``docs``, see ``spans``."""
    base = F.filter("found", lambda s: s["base"])

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS]
    return spans(docs).withColumn("base", base).select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
