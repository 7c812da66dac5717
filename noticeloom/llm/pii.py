"""Personal data by weak supervision, with DataFrame functions alone.

Patterns find candidates; regex, gazetteer and context labelers vote on each; expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is; a logistic classifier of votes, kind and length,
trained on the resulting posteriors, decides which candidates beside the base ones are spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.session import ensure_checkpoint_dir

# Base patterns. Possessive, and begun only where a run begins or a match has ended, so that they take
# time in proportion to the text and no stack; they find what the plain patterns find.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# IBANs, compact or in groups of four, of 15 to 34 characters. The last group may be shorter, but for the
# countries whose numbers are whole groups; after a space it holds a digit, so that it isn't the next word (but in
# MU and SC, where it ends in a currency's letters).
GROUP = r"(?:\x20?[A-Z0-9]{4})"
REST = r"(?:\x20(?=[A-Z]{0,2}[0-9]))?[A-Z0-9]"
WHOLE = "AD|AL|AT|AZ|BA|BE|BY|CY|CZ|DO|EE|ES|GT|HN|HU|KZ|LB|LC|LT|LU|MD|NI|PK|PL|RO|SA|SE|SK|SV|TN|VG|XK"
IBAN = (
    rf"(?<![A-Za-z0-9])(?:(?:MU|SC)[0-9]{{2}}{GROUP}{{6}}\x20?[A-Z]{{2,3}}"
    rf"|(?!{WHOLE})[A-Z]{{2}}[0-9]{{2}}(?:{GROUP}{{3,6}}{REST}{{1,3}}|{GROUP}{{7}}{REST}{{1,2}}|{GROUP}{{2}}{REST}{{3}})"
    rf"|[A-Z]{{2}}[0-9]{{2}}{GROUP}{{3,7}})(?![A-Za-z0-9])"
)
# Further kinds, in the order in which a match is given one, and how each looks as a whole.
MORE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "iban": IBAN,
    "mailto": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{2,}+",
    "person": r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]++(?:\x20[A-ZÀ-Þ][a-zß-ÿ]++)?",
}
ANY_MORE = "|".join(f"(?:{p})" for p in MORE.values())
KINDS = (*BASE, *MORE)
SPAN = "struct<start:int,rank:int,end:int,kind:string,combo:string>"
RUN = 256
# Gazetteers and the words of contexts.
NAMES = "james|mary|john|patricia|robert|jennifer|michael|linda|david|anna|peter|thomas|maria|jean|marie|pierre|hans|klaus|ursula|jose|carmen|luis|smith|johnson|brown|jones|miller|davis|wilson|taylor|müller|schmidt|schneider|fischer|weber|martin|bernard|dubois|garcía|garcia|lopez|martinez"
HOSTS = "gmail|yahoo|hotmail|outlook|icloud|gmx|web|mail|example|proton"
SEEK = r"(?i)(?:e-?mails?|mail|contact|reach|write|tel|phones?|call|fax|mobile|cell|ssn|social security|iban|account|konto|card|visa|name|address|adresse|ip|host|server|telefon|téléphone|teléfono|correo)[\x20:=.#-]*$"
SHUN = r"(?i)(?:isbn|issn|doi|version|ver|release|build|order|invoice|ref|no|nr|page|sku|part|serial|rule|section|chapter)[\x20:=.#-]*$"
LABELERS = 5
CONTEXT = 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    n = F.length(digits)
    doubled = lambda i: F.when((n - i) % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_holds(kind: str, match: Column) -> Column:
    """Whether a base pattern's match is one: ip parts up to 255, card 12 to 19 digits by Luhn, phone 9 to 15 digits."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(only_digits(match)).between(12, 19), luhn(only_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(only_digits(match)).between(9, 15)
    return F.lit(True)


def may_match(kind: str, text: Column) -> Column:
    """A cheap test that texts without the kind mostly fail: one plain pattern or substring after the other, for the further kinds."""
    if kind in ("email", "phone"):
        return text.contains({"email": "@", "phone": "+"}[kind])
    if kind in BASE:
        return text.rlike("[0-9]")
    return text.rlike("[0-9]{3}") | text.contains("at)") | text.contains("at]") | text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}") | text.rlike(r"[MDPHFS](?:rs?|s|rof|err|rau|me|ra?)\.?\x20")


def running(items: Column, kind: str, begin: int, step) -> Column:
    """What step(state, x) -> (next state, value) gives for each item in turn, from the state `begin`; kind: the values' type.

    Items are taken in runs of RUN: appending to an array copies it, so one array of all values would take time in
    proportion to their square.
    """
    empty = lambda of: F.expr(f"cast(array() as array<{of}>)")

    def one(acc, x):
        state, value = step(acc["at"], x)
        return F.struct(state.alias("at"), F.array_append(acc["out"], value).alias("out"))

    def run(acc, part):
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(begin))
        return F.array_append(acc, F.aggregate(part, F.struct(at.alias("at"), empty(kind).alias("out")), one))

    def whole(xs):
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(RUN))
        parts = F.transform(starts, lambda i: F.slice(xs, i, F.lit(RUN)))
        return F.flatten(F.transform(F.aggregate(parts, empty(f"struct<at:int,out:array<{kind}>>"), run), lambda x: x["out"]))

    return F.transform(F.array(items), whole)[0]  # within a lambda, so that items are evaluated once


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, match, before>> of a pattern's matches: split gives what lies between them."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(between, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def step(at, x):
        start = at + F.length(x["p"])
        return start + F.length(x["m"]), F.struct(start.alias("start"), x["m"].alias("match"), F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"))

    return running(pairs, "struct<start:int,match:string,before:string>", 0, step)


def apart(spans: Column) -> Column:
    """Of spans by start, then rank: base ones, and those that touch none of them."""
    base = lambda x: x["rank"] < len(BASE)
    marked = f"struct<x:{SPAN},hit:boolean>"

    def forwards(end, x):
        return F.when(base(x), F.greatest(end, x["end"])).otherwise(end), F.struct(x.alias("x"), (end > x["start"]).alias("hit"))

    def backwards(start, y):
        x = y["x"]
        return F.when(base(x), F.least(start, x["start"])).otherwise(start), F.struct(x.alias("x"), (y["hit"] | (start < x["end"])).alias("hit"))

    seen = running(F.reverse(running(spans, marked, 0, forwards)), marked, (1 << 31) - 1, backwards)
    return F.transform(F.filter(F.reverse(seen), lambda y: base(y["x"]) | ~y["hit"]), lambda y: y["x"])


def kind_of(match: Column) -> Column:
    """Which further kind a match of ANY_MORE is."""
    out = F.lit("person")
    for kind in ("mailto", "iban", "local", "ssn"):
        shape = {"ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "local": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", "iban": r"^[A-Z]{2}[0-9]{2}", "mailto": r"[\[(]at[\])]"}[kind]
        out = F.when(match.rlike(shape), kind).otherwise(out)
    return out


def votes(kind: Column, match: Column, before: Column) -> Column:
    """The labelers' votes, 1 for, -1 against, 0 none, joined by commas: shape, validity, gazetteer, two of context."""
    digits = only_digits(match)
    shape = F.when(kind.isin("email", "iban", "mailto"), 1).when(kind == "person", F.when(match.rlike(r"\.\x20"), 1).otherwise(0)).when(kind == "ip", F.when(match.rlike(r"^0\.|\.0\.0\."), -1).otherwise(1)).when(kind == "card", F.when(match.rlike("^[0-9]{4}[ -][0-9]{4}|^[0-9]{15,16}$"), 1).otherwise(-1)).otherwise(0)
    valid = F.when(kind == "ssn", F.when(digits.rlike("^(?:000|666|9)|^...00|0000$"), -1).otherwise(1)).when(kind == "local", F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)).when(kind == "phone", F.when(F.length(digits) >= 10, 1).otherwise(-1)).when(kind == "card", F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)).when(kind == "iban", F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), 1).otherwise(-1)).otherwise(0)
    listed = F.when(kind.isin("email", "mailto"), F.when(match.rlike(rf"(?i)(?:{HOSTS})|(?:com|org|net|de|fr|es)$"), 1).otherwise(-1)).when(kind == "person", F.when(match.rlike(rf"(?i)\b(?:{NAMES})\b"), 1).otherwise(0)).otherwise(0)
    seek = F.when(before.rlike(SEEK), 1).otherwise(0)
    shun = F.when(before.rlike(SHUN), -1).otherwise(0)
    return F.concat_ws(",", *(x.cast("string") for x in (shape, valid, listed, seek, shun)))


def candidate_spans(column: Column) -> Column:
    """array<struct<start, rank, end, kind, combo>> of base spans and other candidates of a text, by start, kind."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    kind_spans = []
    for kind, pattern in BASE.items():
        kind_spans.append(_named(_held(kind, F.when(may_match(kind, text), located(text, pattern))), lambda m, kind=kind: F.lit(kind)))
    other = F.when(may_match("more", text), located(text, ANY_MORE))
    kind_spans.append(_named(other, kind_of))
    return F.array_sort(F.concat(*kind_spans))


def _held(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: base_holds(kind, x["match"]))


def _named(found: Column, kind_for) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def one(x):
        kind, size = kind_for(x["match"]), F.length(x["match"])
        combo = F.concat_ws("|", kind, votes(kind, x["match"], x["before"]), F.when(size < 12, "s").when(size < 20, "m").otherwise("l"))
        return F.struct(x["start"].alias("start"), ranks[kind].alias("rank"), (x["start"] + size).alias("end"), kind.alias("kind"), combo.alias("combo"))

    return F.coalesce(F.transform(found, one), F.expr(f"cast(array() as array<{SPAN}>)"))


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 30) -> tuple[list[float], dict[tuple[int, ...], float]]:
    """Each labeler's chance of being right when it votes, and each pattern's posterior, by expectation-maximisation.

    Chances start at 0.7 and stay in 0.05 to 0.95, with two votes added to each side; the share of true candidates
    starts at 0.5.
    """
    right, share, posterior = [0.7] * LABELERS, 0.5, {}
    for _ in range(rounds):
        for p in patterns:
            log = math.log(share / (1 - share)) + sum(v * math.log(r / (1 - r)) for v, r in zip(p, right, strict=True) if v)
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
        for j in range(LABELERS):
            agree = sum(n * (posterior[p] if p[j] > 0 else 1 - posterior[p]) for p, n in patterns.items() if p[j])
            cast = sum(n for p, n in patterns.items() if p[j])
            right[j] = min(0.95, max(0.05, (agree + 1.4 * 2) / (cast + 2 * 2)))
        total = sum(patterns.values())
        share = min(0.95, max(0.05, (sum(n * posterior[p] for p, n in patterns.items()) + 1) / (total + 2)))
    return right, posterior


def train(counts: dict[str, int], rounds: int = 300) -> set[str]:
    """The combinations of kind, votes and length that the span classifier accepts.

    counts has a row for each combination that occurs, at most kinds x 3 ** labelers x 3. The classifier is a logistic
    regression on the posteriors, each combination weighted by its count.
    """
    split = {c: (c.split("|")[0], tuple(map(int, c.split("|")[1].split(","))), c.split("|")[2]) for c in counts}
    patterns: dict[tuple[int, ...], float] = {}
    for c, (_, p, _) in split.items():
        patterns[p] = patterns.get(p, 0) + counts[c]
    _, posterior = reliabilities(patterns)
    traits = {c: [f"kind {k}", f"size {s}", "all", *(f"{j} {v}" for j, v in enumerate(p) if v)] for c, (k, p, s) in split.items()}
    weight: dict[str, float] = {t: 0.0 for ts in traits.values() for t in ts}
    total = max(1, sum(counts.values()))
    for _ in range(rounds):
        slope = {t: -0.001 * w for t, w in weight.items()}
        for c, ts in traits.items():
            gap = posterior[split[c][1]] - 1 / (1 + math.exp(-sum(weight[t] for t in ts)))
            for t in ts:
                slope[t] += gap * counts[c] / total
        for t in weight:
            weight[t] += slope[t]
    return {c for c, ts in traits.items() if sum(weight[t] for t in ts) >= 0}


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, base, spans: arrays of struct<start, rank, end, kind, combo>.

    base: what the base patterns find in the whole text, whatever the classifier thinks; spans: these and accepted
    candidates of further kinds that touch no base span, all by start, then kind. Places count code points, the
    end is exclusive. Null text counts as empty. One row for each row of docs, null or repeated ids included.
    Empty table: no rows. Other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), candidate_spans(F.col(text_col)).alias("spans")).checkpoint()
    accepted = classifier(rows.select("spans"))
    return rows.select("doc_id", F.filter("spans", is_base).alias("base"), chosen(F.col("spans"), accepted).alias("spans"))


def is_base(span: Column) -> Column:
    return span["rank"] < len(BASE)


def chosen(spans: Column, accepted: set[str]) -> Column:
    """Of candidates the base spans, and the accepted ones that touch none of them."""
    held = F.filter(spans, lambda x: is_base(x) | accepts(accepted, x["combo"]))
    mixed = F.exists(held, lambda x: ~is_base(x)) & F.exists(held, is_base)
    return F.when(mixed, apart(held)).otherwise(held)


def classifier(rows: DataFrame) -> set[str]:
    """The accepted combinations, from all candidates of rows (spans, ...)."""
    found = rows.select(F.explode("spans").alias("s")).groupBy("s.combo").count().collect()  # bounded: see train
    return train({r["combo"]: r["count"] for r in found})


def accepts(accepted: set[str], combo: Column) -> Column:
    return combo.isin(sorted(accepted)) if accepted else F.lit(False)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def covers(spans: Column) -> Column:
    """array<struct<from, upto, kind>>, apart and by place: spans that overlap as one, of the first one's kind."""

    def forwards(end, x):
        return F.greatest(end, x["end"]), F.struct(x.alias("x"), (x["start"] >= end).alias("begins"), F.greatest(end, x["end"]).alias("upto"))

    def backwards(upto, y):  # the greatest end of what has come since the last beginning
        whole = F.greatest(upto, y["upto"])
        return F.when(y["begins"], 0).otherwise(whole), F.struct(y["x"]["start"].alias("from"), whole.alias("upto"), y["x"]["kind"].alias("kind"), y["begins"].alias("begins"))

    seen = running(spans, f"struct<x:{SPAN},begins:boolean,upto:int>", 0, forwards)
    back = running(F.reverse(seen), "struct<from:int,upto:int,kind:string,begins:boolean>", 0, backwards)
    return F.reverse(F.filter(back, lambda y: y["begins"]))


def replaced(text: Column, places: Column) -> Column:
    """The text with each of the places (from, upto, kind) replaced by its kind in angle brackets.

    Finding a place reads a text from its beginning, so the text is first cut at every RUNth place.
    """
    cut = lambda t, start, end: F.substring(t, start + 1, end - start)

    def part(xs, begin, end, segment):
        starts = F.concat(F.array(begin), F.transform(xs, lambda x: x["upto"]))
        pieces = F.transform(xs, lambda x, i: F.concat(cut(segment, F.element_at(starts, i + 1) - begin, x["from"] - begin), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(pieces, ""), cut(segment, F.element_at(starts, -1) - begin, end - begin))

    def whole(xs, size):
        def run(i):
            own = F.slice(xs, i, F.lit(RUN))
            begin = F.when(i == 1, 0).otherwise(F.try_element_at(xs, F.greatest(i - 1, F.lit(1)))["upto"])
            end = F.when(i + RUN > F.size(xs), size).otherwise(F.try_element_at(xs, F.least(i + RUN - 1, F.size(xs)))["upto"])
            return F.transform(F.array(F.struct(own.alias("own"), begin.alias("begin"), end.alias("end"))), lambda r: part(r["own"], r["begin"], r["end"], cut(text, r["begin"], r["end"])))[0]

        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(RUN)), run), "")

    return F.when(F.size(places) > 0, F.transform(F.array(places), lambda xs: whole(xs, F.length(text)))[0]).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of pii_spans replaced by its kind in angle brackets: <email>, <ip>, <card>, ...

    Spans that overlap are replaced as one, by the kind of the first. Null texts stay null. All other columns stay as
    they are. The documents are written to the checkpoint folder once, beside their candidates.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), candidate_spans(F.col(text_col)).alias("spans")).checkpoint()
    accepted = classifier(rows.select("spans"))
    text = F.col("doc")[text_col].cast("string")
    places = F.when(F.size("spans") > 0, covers(chosen(F.col("spans"), accepted)))
    rows = rows.select("doc", F.coalesce(replaced(text, places), text).alias("new"))
    return rows.select(*(F.col("new").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns))


def op3_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    out = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
