"""Personal data by bootstrapped contextual extraction.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by their
form, and keys that stand behind an equals sign or colon and look random.  The words
around seeds, to the left, to the right and on both sides, are lexical patterns; the
words around other identifier-like strings join the same graph.  Pattern and
instance scores are computed in turn: a pattern is worth the share of its
distinct instances already known to be of its kind, if its words mostly stand beside
such, and an instance what its patterns together suggest.  Strings that trusted
patterns introduce are added as spans of that kind; seeds always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, utf8

# The kinds in their order and their forms.  Each form is written
# so that a long run of its characters is read once.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
#: Identifier-like: a token with a digit or @, and number groups that follow it.
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [0-9()-]++)*+")
#: What stands behind an equals sign or a colon, with digits or without.
_ASSIGNED = re.compile(r"[=:]\s{0,3}+[\"']?+([A-Za-z0-9+_~.-]{8,}+)")
_CHANGES = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
_WORD = re.compile(r"[^\W_]+")

#: The kind that only the method adds: keys, tokens and passwords.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")

#: Longer words stand in patterns by their digest.
LONGEST_WORD = 64


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all seeds, by start, then kind; ends are exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(g := p.lstrip("0")) < 4 and int(g or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def looks_random(s: str) -> bool:
    """Whether a string has the form of a key: 20 characters or more that change between letters and digits often."""
    return len(s) >= 20 and len(_CHANGES.findall(s)) >= 6


def fits(kind: int, s: str) -> bool:
    """Whether a string that is no seed may be of a kind at all."""
    digits = len(_NOT_DIGITS.sub("", s))
    if kind == 0:
        return "@" in s
    if kind == 1:
        return s.count(".") == 3 and digits >= 4
    if kind == 2:
        return 12 <= digits <= 19 and not re.search(r"[^\W\d_]", s)
    if kind == 3:
        return 7 <= digits <= 15 and not re.search(r"[^\W\d_]", s)
    return len(s) >= 8 and re.fullmatch(r"[A-Za-z0-9+_~.-]+", s) is not None and re.search(r"[A-Za-z]", s) is not None


class _Contexts:
    """The patterns around places of a text, over line breaks: the word before, the two before, the
    word after, and those on both sides.  Digits of a word count as one shape."""

    def __init__(self, text: str):
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in found], [b for _, b in found]

    def word(self, i: int) -> str:
        w = _DIGITS.sub("0", self.text[self.starts[i] : self.ends[i]].lower())
        return w if len(w) <= LONGEST_WORD else hashlib.sha1(w.encode()).hexdigest()

    def around(self, start: int, end: int) -> list[str]:
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        before = [self.word(k) for k in range(max(0, i - 2), i)]
        after = [self.word(j)] if j < len(self.starts) else []
        out = [f"L {before[-1]}"] if before else []
        if len(before) == 2:
            out.append("L " + " ".join(before))
        out += [f"R {w}" for w in after]
        return out + [f"B {before[-1]} {w}" for w in after if before]


def candidates(t: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int | None, list[int], list[str]]]:
    """Start, end, kind of a seed, possible kinds and patterns of all seeds and identifier-like strings."""
    assigned = [m.span(1) for m in _ASSIGNED.finditer(t)] if "=" in t or ":" in t else []
    tokens = []
    for m in _CANDIDATE.finditer(t):
        s = m[0].rstrip(".,;:!?)]}\"'>*#$%&|")
        lead = len(s) - len(s.lstrip("([{\"'<*#$%&|"))
        if len(s) - lead >= 5:
            tokens.append((m.start() + lead, m.start() + len(s)))
    if not spans and not assigned and not tokens:
        return
    contexts = _Contexts(t)
    covered = sorted((a, b) for a, _, b in spans)
    reach, reaches = 0, []
    for _, b in covered:
        reach = max(reach, b)
        reaches.append(reach)

    def free(a: int, b: int) -> bool:
        """Whether no seed by form overlaps: of those that start before the end, none reaches the start."""
        i = bisect_left(covered, (b, -1))
        return i == 0 or reaches[i - 1] <= a

    for a, k, b in spans:
        if patterns := contexts.around(a, b):
            yield a, b, k, [k], patterns
    taken: list[tuple[int, int]] = []
    for a, b in assigned:
        s = t[a:b].rstrip(".")
        if len(s) >= 8 and free(a, a + len(s)) and fits(SECRET, s):
            taken.append((a, a + len(s)))
            yield a, a + len(s), SECRET if looks_random(s) else None, [SECRET], contexts.around(a, a + len(s))
    for a, b in tokens:
        i = bisect_left(taken, (b, -1))
        if (i and taken[i - 1][1] > a) or not free(a, b):
            continue
        kinds = [k for k in range(len(NAMES)) if fits(k, t[a:b])]
        if kinds and (patterns := contexts.around(a, b)):
            yield a, b, None, kinds, patterns


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("kind", pa.int32()), ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
_EXTRACTED = (
    "row long, doc_id long, base array<struct<start: long, kind: int, end: long>>, base_sha256 string, "
    "candidates array<struct<start: long, end: long, instance: string, kind: int, kinds: array<int>, patterns: array<string>>>"
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        base, sha, candidates_of = [], [], []
        for text in batch.column("text"):
            t = text.as_py() or ""
            spans = base_spans(t)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            sha.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            candidates_of.append([{"start": a, "end": b, "instance": t[a:b].lower(), "kind": k, "kinds": kinds, "patterns": patterns} for a, b, k, kinds, patterns in candidates(t, spans)])
        n = len(base)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(sha, pa.string()), pa.array(candidates_of, pa.list_(_CAND))],
            names=["row", "doc_id", "base", "base_sha256", "candidates"],
        )
        row += n


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n of all texts, counted as they stand in patterns; combined before they move."""
    shaped = F.regexp_replace(F.lower(utf8("text")), "[0-9]", "0")
    return texts.select(F.explode(F.split(shaped, r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _discover(extracted: DataFrame, texts: DataFrame, rounds: int, min_support: int, min_pattern: float, min_instance: float, min_beside: float) -> DataFrame:
    """row, start, kind, end of the strings that trusted patterns introduce, and of the seeds that are no base spans; ``led`` tells the first from the second."""
    seen = cut(extracted.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*"), "candidates")
    edges = seen.select("instance", "kind", "kinds", F.explode("patterns").alias("pattern"))
    # One row a pattern and instance, however often they meet: copies count once, but for the share of the words' places.
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("kinds").alias("kinds"), F.count("*").alias("uses")), "edges")
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    words = edges.select("pattern").distinct().select("pattern", F.explode(F.split(F.expr("substring(pattern, 3)"), " ")).alias("word"))
    places = words.join(_word_counts(texts), "word").groupBy("pattern").agg(F.min("n").alias("places"))
    patterns = edges.groupBy("pattern").agg(F.count("*").alias("total")).join(places, "pattern", "left")
    patterns = cut(patterns, "pattern-counts")
    known, trusted = seeds, None
    for _ in range(rounds):
        hits = edges.select("pattern", "instance", "uses").join(known, "instance").groupBy("pattern", F.col("kind"))
        hits = hits.agg(F.sum("score").alias("mass"), F.count("*").alias("support"), F.sum("uses").alias("uses"))
        hits = hits.where(F.col("support") >= min_support).join(patterns, "pattern").withColumn("worth", F.col("mass") / F.col("total"))
        beside = F.col("uses") >= min_beside * F.coalesce("places", "uses")
        trusted = cut(hits.where((F.col("worth") >= min_pattern) & beside).select("pattern", "kind", "worth"), "patterns")
        if trusted.isEmpty():
            break
        fresh = edges.where("kind is null").drop("kind").join(trusted, "pattern").where("array_contains(kinds, kind)")
        fresh = fresh.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("worth"), F.lit(0.999)))))).alias("score"))
        known = cut(seeds.unionByName(fresh.where(F.col("score") >= min_instance)), "known")
    free = seen.where("kind is null").select("row", "start", "end", "instance", "kinds", F.explode("patterns").alias("pattern"))
    led = free.join(trusted, "pattern").where("array_contains(kinds, kind)").select("row", "start", "end", "instance", "kind").distinct()
    best = led.join(known.select("instance", "kind", "score"), ["instance", "kind"]).groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
    best = best.select("row", "start", F.col("b.kind").alias("kind"), "end", F.lit(True).alias("led"))
    return best.unionByName(seen.where(F.col("kind") == SECRET).select("row", "start", "kind", "end", F.lit(False).alias("led")))


def extract(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    min_support: int = 5,
    min_pattern: float = 0.7,
    min_instance: float = 0.7,
    min_beside: float = 0.05,
) -> DataFrame:
    """One row per input row: doc_id, base and found (arrays of start, kind, end; kinds are
    places in ``NAMES``), base_sha256, n_email, n_ip, n_card, n_phone (base only), spans, and
    by origin the numbers of found spans: n_pattern (introduced by trusted patterns), n_form
    (keys told by their form alone, which are seeds).

    A pattern is trusted from ``min_support`` distinct known instances, a share of
    ``min_pattern`` of all its instances, and if its rarest word stands beside a known instance
    at ``min_beside`` of its places in the corpus, so that frequent words introduce nothing; a
    string is added from a combined score of ``min_instance``.  Null and empty texts have no
    spans; repeated rows are read each for itself but teach once; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    extracted = cut(rows.mapInArrow(_extract, _EXTRACTED), "extracted")
    found = _discover(extracted, rows, rounds, min_support, min_pattern, min_instance, min_beside)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"), F.count_if("led").alias("n_pattern"), F.count_if(~F.col("led")).alias("n_form"))
    out = extracted.drop("candidates").join(found, "row", "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start: long, kind: int, end: long>>")))
    names = F.array(*map(F.lit, NAMES))
    text = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        "base_sha256",
        F.concat_ws(",", F.transform(F.array_sort(F.concat("base", "found")), text)).alias("spans"),
        "base",
        "found",
        *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_pattern", "n_form")),
    )
