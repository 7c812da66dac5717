"""Secret scans: fixed patterns, and password guess costs of values in a credential's context.

The cost of a value is the least sum, over all ways to cut it into spans, of the guesses (as log10) for each span
as a common word, a date, a repeat, a keyboard walk or brute force. Words are those common in passwords, then those
most frequent in the documents themselves. A value beside a credential word that costs more than a threshold is a
secret; "password: changeme" isn't.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.importance import largest
from noticeloom.session import ensure_checkpoint_dir

# The base patterns, the least length of what they find, and the words of a context.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CUES = ("passw", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "private_key", "kennwort", "mot de passe", "contraseña", "clave")
BEFORE = (
    r"""(?i:passw(?:or[dt])?|kennwort|mot\x20de\x20passe|contraseña|clave|passphrase|pwd|secret|token|api[_-]?key|credentials?|bearer|private_key)["']?"""
    r"""(?:\x20+(?:is|was|ist|lautet|est|es|=>))?[\x20\xA0\u202F:="'`«„“]+"""
)
CONTEXT = re.compile(BEFORE + r"""([^\s"'`«»„“”])""")  # a value's first character
#: A value: up to the closing quote of its line if a quote is before it, else up to white space.
RUN = re.compile(r"""(?<=")[^"\n]++(?=")|(?<=')[^'\n]++(?=')|(?<=`)[^`\n]++(?=`)|(?<=«)[^»\n]++(?=»)|(?<=[„“])[^“”\n]++(?=[“”])|\S+""")
CLOSERS = ".,;:!?)\"'`»“”"
LEAST = 6
# Common words of passwords by rank, rows of a keyboard, and shapes of dates.
WORDS = (
    "password", "admin", "qwerty", "welcome", "letmein", "login", "secret", "master", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "trustno", "iloveyou", "hello", "freedom", "whatever", "test", "guest", "root", "user",
    "change", "changeme", "default", "example", "sample", "demo", "dummy", "placeholder", "insert", "your", "here", "enter", "token", "key",
    "api", "pass", "word", "none", "null", "undefined", "required", "optional", "string", "value", "field", "reset", "forgot", "the", "and",
    "for", "must", "not", "summer", "winter", "spring", "autumn", "love", "money", "coffee", "computer", "internet", "server", "system",
)
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
UNITS = 8
PARTS = 64
LETTERS = r"^\p{L}{3,24}$"
PLACE = {letter: (row, at) for row, keys in enumerate(ROWS) for at, letter in enumerate(keys)}
PLAIN = str.maketrans("@4301!$57", "aaeoiisst")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, costs array<double>"


def _alphabet(value: str) -> float:
    """log10 of the number of characters of the value's classes; a letter beyond ASCII makes it a hundred larger."""
    size = 100 * (not value.isascii()) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log10(max(size, 10))


def _cheapest(held: list[tuple[int, float]], j: int, unit: int = 1) -> float:
    """The least of a start's cost and log10 of the units from it to j, over starts in order whose costs rise.

    A start that an earlier, cheaper one beats is dropped: it stays beaten, as the logs only draw nearer to each other.
    """
    kept, best = [], math.inf
    for i, before in held:
        here = before + math.log10((j - i) // unit)
        if here < best:
            kept.append((i, before))
            best = here
    held[:] = kept
    return best


def _hold(held: list[tuple[int, float]], i: int, before: float) -> None:
    while held and held[-1][1] >= before:
        held.pop()
    held.append((i, before))


def ranked(words) -> dict[str, int]:
    """The rank of each word: common words of passwords, then the given ones in their order."""
    return {word: i + 1 for i, word in enumerate(dict.fromkeys((*WORDS, *words)))}


KNOWN = ranked(())
PER_TURN = math.log10(4)


def guess_cost(value: str, rank: dict[str, int] = KNOWN) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes; 0 for an empty one.

    cost[j] is the least, over spans i..j, of cost[i] plus the span's: a word its rank plus one (four times the rank, with
    capitals or letters written as digits); a date its days of 200 years; two units or more of up to UNITS characters,
    three in all, brute force for one unit, times the units; a keyboard walk of three keys or more 47 starts times its
    length and four times for each turn; else brute force for each character of the value's alphabet. A repeat of a
    longer unit costs what its characters do. Starts of repeats and walks are held from one j to the next, so that
    values of any length are costed whole in time that grows with the length.
    """
    n, each = len(value), _alphabet(value)
    lower = value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, longest = lower.translate(PLAIN), max(map(len, rank), default=0)
    cost = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for at in range(n):
        if m := DATE.match(value, at):
            dates.setdefault(m.end(), []).append(at)
    walk = [1] * n  # length of the keyboard walk that ends here
    turns = [0] * (n + 1)  # turns up to here, over all walks
    walks: list[tuple[int, float]] = []
    same = [0] * (UNITS + 1)  # by unit: how many characters up to here equal the one a unit before
    repeats: list[list[list[tuple[int, float]]]] = [[[] for _ in range(unit)] for unit in range(UNITS + 1)]
    step = None
    for j in range(1, n):
        (a, b), (c, d) = PLACE.get(lower[j - 1], (9, 0)), PLACE.get(lower[j], (99, 0))
        last, step = step, (c - a, d - b)
        turns[j] = turns[j - 1]
        if max(abs(c - a), abs(d - b)) == 1:
            walk[j] = walk[j - 1] + 1
            turns[j] += walk[j - 1] > 1 and step != last
    for j in range(1, n + 1):
        best = cost[j - 1] + each
        for i in range(max(0, j - longest), j - 2):
            place = rank.get(lower[i:j]) or rank.get(plain[i:j])
            if place:
                best = min(best, cost[i] + math.log10(place * (1 if value[i:j].islower() and value[i:j].isalpha() else 4) + 1))
        for i in dates.get(j, ()):
            best = min(best, cost[i] + math.log10(200 * (366 if j - i > 4 else 1)))
        if walk[j - 1] > 2:
            _hold(walks, j - 3, cost[j - 3] - PER_TURN * turns[j - 2])  # the first step of a walk is no turn
            best = min(best, _cheapest(walks, j) + PER_TURN * turns[j - 1] + math.log10(47))
        elif walks:
            walks.clear()
        for unit in range(1, min(UNITS, j - 1) + 1):
            if value[j - 1] != value[j - 1 - unit]:
                if same[unit]:
                    same[unit], repeats[unit] = 0, [[] for _ in range(unit)]
                continue
            same[unit] += 1
            least = max(unit, 2)  # a repeat has two units and three characters at least
            if same[unit] >= least:
                held = repeats[unit][j % unit]
                _hold(held, j - unit - least, cost[j - unit - least])
                best = min(best, unit * each + _cheapest(held, j, unit))
        cost[j] = best
    return cost[n]


def frequent_words(docs: DataFrame, vocabulary: int, text_col: str) -> list[str]:
    """The `vocabulary` most frequent words of 3 to 24 letters, in lower case, counted over all documents.

    Values in credential contexts aren't counted, or a secret would make itself a word.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    value = re.compile(BEFORE + f"(?:{RUN.pattern})")

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            near = pc.match_substring_regex(texts, "(?i)" + "|".join(CUES))
            texts = pa.chunked_array([texts.filter(pc.invert(near)), pa.array([value.sub(" ", x) for x in texts.filter(near).to_pylist()], pa.string())])
            words = pc.list_flatten(pc.ascii_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))).combine_chunks()
            seen = pc.value_counts(pc.ascii_trim(words, ".,;:!?'\"()"))
            words, n = seen.field("values"), seen.field("counts")
            held = pc.match_substring_regex(words, LETTERS)
            yield pa.RecordBatch.from_arrays([words.filter(held).cast(pa.string()), n.filter(held)], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull()).mapInArrow(count, "word string, n long")
    rows = rows.groupBy("word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(PARTS))).orderBy(F.desc("n"), "word")  # the most frequent of each part
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= vocabulary).select("word", "n").checkpoint()
    least = largest(rows.select(F.col("n").cast("double").alias("key")), vocabulary)  # of all parts, counted in bins
    above = rows.filter(F.col("n") > least).collect() if least is not None else rows.collect()
    if least is not None:
        above += rows.filter(F.col("n") == least).orderBy("word").limit(vocabulary - len(above)).collect()
    return [r["word"] for r in sorted(above, key=lambda r: (-r["n"], r["word"]))]  # vocabulary rows at most


def secret_spans(text: str, least_cost: float, rank: dict[str, int] = KNOWN) -> tuple[list[tuple[int, int, str]], list[float]]:
    """(start, end, kind) of every span, and the costs of those of kind guess, in order."""
    spans, costs = [], []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    lower = text.lower()
    if any(x in lower for x in CUES):
        base = sorted(spans)
        starts, ends = [a for a, _, _ in base], [0, *accumulate((b for _, b, _ in base), max)]
        at = run = 0
        while m := CONTEXT.search(text, at):
            lo = m.start(1)
            if lo >= run:  # else within a run whose end is known
                run = RUN.match(text, lo).end()
            at = run
            covered = ends[bisect_right(starts, lo)]
            if covered > lo:  # the value begins in a base match: what comes after that is looked at again
                at = covered
                continue
            following = bisect_left(starts, lo)
            if following < len(starts):
                at = min(at, starts[following])
            value = text[lo:at].rstrip(CLOSERS)
            hi = lo + len(value)
            if len(value) < LEAST:
                continue
            cost = guess_cost(value, rank)
            if cost >= least_cost:
                spans.append((lo, hi, "guess"))
                costs.append(cost)
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))), costs


def secret_scan(docs: DataFrame, least_cost: float = 12.0, vocabulary: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base, spans, costs.

    base: kind:start:end of the fixed patterns' matches, spans: of these and of values of kind guess, by start, then
    kind, joined by commas; places count code points, the end is exclusive. costs: log10 of the guesses for each
    value of kind guess. A value follows a credential word in English, German, French or Spanish and goes on to the closing
    quote if it is quoted, spaces included, else to white space. It may be of any length and of any characters (those that
    no span knows cost brute force), costs least_cost at least and ends where a base match begins, so it touches none. Costs know the words of WORDS and the `vocabulary` words that are most frequent in docs.
    Null text counts as empty. One row for each row of docs, null or repeated ids included. Empty table: no rows. Other columns aren't read.
    """
    rank = ranked(frequent_words(docs, vocabulary, text_col))

    def scan(batches):
        for batch in batches:
            counts, base, spans, costs = ([], [], []), [], [], []
            for text in batch.column(1).to_pylist():
                found, cost = secret_spans(text or "", least_cost, rank)
                for kind, out in zip(KINDS, counts, strict=False):
                    out.append(sum(k == kind for _, _, k in found))
                base.append(",".join(f"{k}:{a}:{b}" for a, b, k in found if k != "guess"))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
                costs.append(cost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(costs, pa.list_(pa.float64()))],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, RESULT)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
