"""Secret scans over a trigram index: Boolean trigram queries pick the texts on which a rule's regex has to run."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as parts, _parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardframe.llm.common import ascii_lower, let, small_or_not, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the number of characters that ``group`` (0: the whole match) must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The three base kinds of the contract, in its order.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
]
# A private key through its END line; without one, the headers and lines of base64 letters that follow, or long runs of these letters
# where line ends became blanks. Line ends may be escaped, lines quoted or indented. Repeats do not go back, so a scan is linear.
KEY_MARK = r"[A-Z ]*PRIVATE KEY-----"
KEY_BREAK = r"""(?:[\x20\t"',;+|]*+(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t>"'#*|+]*+)"""
KEY_LINE = rf"""(?:{KEY_BREAK}++(?:[A-Za-z][A-Za-z-]*+:[^\r\n\\]*+|[A-Za-z0-9+/=]++(?=[\x20\t"',;|]*(?:[\r\n\\]|\Z)))"""
KEY_LINE += r"""|[\x20\t]++(?:[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+)(?=\s|\Z))"""
# Published shapes of further credentials.
MORE = [
    Rule("private_key", rf"-----BEGIN {KEY_MARK}(?:[^-]*+(?:-{{1,4}}+[^-]++)*+-----END {KEY_MARK}|{KEY_LINE}*+)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
]
MOST_STRINGS = 64


def _strings(node) -> list[list[str] | None]:
    """A parsed regex as a sequence of sets of strings; None stands for anything else and cuts the sequence."""
    out: list[list[str] | None] = []
    for op, value in node:
        if op is parts.LITERAL:
            out.append([chr(value)])
        elif op is parts.SUBPATTERN:
            out.extend(_strings(value[3]))
        elif op is parts.BRANCH:
            options = [_joined(_strings(b)) for b in value[1]]
            out.append(None if any(o is None for o in options) else [s for o in options for s in o])
        elif op is parts.IN and all(k is parts.LITERAL for k, _ in value):
            out.append([chr(v) for _, v in value])
        elif op is parts.MAX_REPEAT and value[1] == 1:
            inner = _joined(_strings(value[2]))
            out.append(None if inner is None else ["", *inner])
        elif op is parts.MAX_REPEAT and value[0] >= 1:
            inner = _joined(_strings(value[2]))
            out.extend([None] if inner is None else [*[inner] * value[0], *([None] if value[1] != value[0] else [])])
        else:
            out.append(None)
    return out


def _joined(sets: list[list[str] | None]) -> list[str] | None:
    if any(s is None for s in sets):
        return None
    n = 1
    for s in sets:
        n *= len(s)
    return ["".join(p) for p in product(*sets)] if n <= MOST_STRINGS else None


def trigram_query(regex: str) -> list[list[list[str]]]:
    """What any match must contain: an AND of ORs of ANDs of lower-case trigrams. Empty: the regex needs no trigram."""
    query = []
    run: list[list[str]] = []
    for s in [*_strings(_parser.parse(regex)), None]:
        if s is not None and _joined([*run, s]) is not None:
            run.append(s)
            continue
        options = [sorted({w[i:i + 3].lower() for i in range(len(w) - 2)}) for w in _joined(run) or []]
        if options and all(options):
            query.append(options)
        run = [s] if s is not None else []
    return query


def trigram_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the given lower-case trigrams: a row for each text that has one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull())
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(let(ascii_lower(F.col("text")), found)).alias("trigram"))


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, list[list[list[str]]]]) -> DataFrame:
    """Intersect postings: (doc_id, text_hash, rules) with the rules whose trigram query the text satisfies.

    Postings are grouped by text, so a trigram that very many texts have makes no hot key. The queries' size is that of
    the rules, whatever the corpus.
    """
    terms = [(rule, c, o, g, len(option), len(query)) for rule, query in queries.items() for c, clause in enumerate(query)
             for o, option in enumerate(clause) for g in option]
    asked = spark.createDataFrame(terms, "rule string, clause int, option int, trigram string, need int, clauses int")
    return (index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "text_hash", "rule", "clause", "option", "need", "clauses")
            .agg(F.countDistinct("trigram").alias("n")).filter("n = need")
            .groupBy("doc_id", "text_hash", "rule", "clauses").agg(F.countDistinct("clause").alias("n")).filter("n = clauses")
            .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("rule")).alias("rules")))


def _spans(text: Column, rule: Rule, nth: int) -> Column:
    """Leftmost non-overlapping matches as (start, nth, end, kind): code points, end exclusive; failing ones are dropped.

    Matches and the text between them are cut out by the same regex; adding up their lengths gives the places.
    """
    rx = F.lit(rule.regex)
    cut = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("g"),
                   F.split(text, rule.regex, -1).alias("between"))
    kind = "array<struct<start:int,nth:int,end:int,kind:string>>"
    walked = let(cut, lambda c: F.aggregate(
        F.zip_with(F.zip_with(c["m"], c["g"], lambda m, g: F.struct(F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok"))),
                   F.slice(c["between"], 1, F.size(c["m"])), lambda m, b: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), F.length(b).alias("gap"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["ok"], F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["gap"]).alias("start"), F.lit(nth).alias("nth"), (a["at"] + x["gap"] + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))))
        ).otherwise(a["out"]).alias("out")))["out"])
    return F.when(text.rlike(rule.regex), walked).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", into: str = "secrets") -> DataFrame:
    """Add ``into``: the spans (start, nth rule, end, kind) of all rules in the whole text, by start, then rule.

    A rule whose regex has mandatory trigrams runs only on the texts that the index names for it; a rule without any runs
    on all. All columns stay; one named ``into`` is replaced. A null or empty text has no spans and repeated rows get
    equal ones. The index is written; its result is broadcast to the texts only if it is small, and is joined on
    (doc_id, hash of the text) otherwise, a key of which only repeated rows have many.
    """
    rules = rules or [*BASE, *MORE]
    docs = docs.drop(into)
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    kind = "array<struct<start:int,nth:int,end:int,kind:string>>"

    def found(t: Column, wanted: Column | None) -> Column:
        each = []
        for nth, r in enumerate(rules):
            spans = _spans(t, r, nth)
            each.append(F.when(F.array_contains(wanted, r.kind), spans).otherwise(F.array().cast(kind)) if r.kind in indexed else spans)
        return F.sort_array(F.concat(*each))

    whole = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if not indexed:
        return docs.withColumn(into, let(whole(F.col(text)), lambda t: found(t, None)))
    index = written(trigram_index(docs, sorted({g for q in indexed.values() for c in q for o in c for g in o}), doc_id, text))
    named = small_or_not(candidates(docs.sparkSession, index, indexed))
    joined = docs.alias("d").join(named.alias("c"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("c.doc_id"))
                                  & (F.xxhash64(whole(F.col(f"d.`{text}`"))) == F.col("c.text_hash")), "left")
    return joined.select("d.*", let(F.struct(whole(F.col(f"d.`{text}`")).alias("t"), F.coalesce("c.rules", F.array().cast("array<string>")).alias("r")),
                                    lambda s: found(s["t"], s["r"])).alias(into))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **names) -> DataFrame:
    """Replace every span of :func:`scan` by ``mark``; columns and rows stay. Overlapping spans become one mark."""
    into = "__secrets"
    scanned = scan(docs, text=text, into=into, **names)

    def cleaned(t: Column) -> Column:
        done = F.aggregate(F.col(into), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out")))
        return let(done, lambda d: F.concat(d["out"], F.substring(t, d["at"] + 1, F.length(t))))

    return scanned.withColumn(text, F.when(F.size(into) > 0, cleaned(F.col(text))).otherwise(F.col(text))).drop(into)
