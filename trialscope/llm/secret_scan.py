"""Secret scanning with a trigram inverted index. DataFrame functions only.

Each rule's regex yields a Boolean trigram query: an OR of branches, each an AND of trigrams that any match must
hold (lower-cased). Postings (trigram, document) of the queries' trigrams are intersected: a branch whose
trigrams all list a document makes it a candidate of the rule, and only candidates are verified with the regex.
A rule without mandatory trigrams (a run of hex digits) is a candidate everywhere and scans fully.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts, and the least length of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: fixed values: the base rules, in the order they are listed
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: further rules of this operator; what they find is added to the base spans
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def literals(pattern: str) -> list[list[str]]:
    """Branches of a regex: of each, the literal strings that a match of it must hold.

    Understands what rules are written in: literal characters, classes, groups with alternatives and the
    quantifiers ? * + {m,n}. A class of over 8 characters or an optional part ends a literal; a smaller class gives
    a branch a character, and an optional character two branches.
    """
    import re._parser as parser

    def walk(nodes) -> list[list[str]]:
        out = [[""]]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                parts = [[chr(arg)]]
            elif name == "IN" and len(arg) <= 8 and all(str(kind) == "LITERAL" for kind, _ in arg):
                parts = [[chr(c)] for _, c in arg]
            elif name == "SUBPATTERN":
                parts = walk(arg[3])
            elif name == "BRANCH":
                parts = [b for way in arg[1] for b in walk(way)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1) and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                parts = [[""], [chr(arg[2][0][1])]]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                parts = [["", *b, ""] for b in walk(arg[2])]
            else:
                parts = [["", ""]]
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in parts]
        return out

    return walk(parser.parse(pattern))


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams; empty if some branch has none, so that every text may match."""
    branches = []
    for strings in literals(pattern):
        grams = sorted({s[i:i + 3] for s in (x.lower() for x in strings) for i in range(len(s) - 2)})
        if not grams:
            return []
        branches.append(grams)
    return sorted(map(list, {tuple(b) for b in branches}))


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, kind, end) of the rule's matches that pass, in code points, as columns of the row."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    size = F.transform(every, F.char_length)
    counted = size if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
    # between the matches stand the pieces of split, so lengths give the places
    before = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(every)), F.char_length)
    steps = F.arrays_zip(before.alias("before"), size.alias("size"), counted.alias("counted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("found"))

    def place(done: Column, m: Column) -> Column:
        at, end = done["at"] + m["before"], done["at"] + m["before"] + m["size"]
        one = F.array(F.struct(at.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end")))
        return F.struct(end.alias("at"), F.when(m["counted"] >= rule.least, F.concat(done["found"], one)).otherwise(done["found"]).alias("found"))

    return F.aggregate(steps, start, place, lambda done: done["found"])


def _search_form(rule: Rule) -> str:
    """For a rule that is one run of a class, the run of at least the counted length: it finds the same spans."""
    m = re.fullmatch(r"([A-Za-z]*)(\[[^\]]+\])\+", rule.pattern)
    if rule.group or not m:
        return rule.pattern
    return f"{m[1]}{m[2]}{{{max(1, rule.least - len(m[1]))},}}"


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index: (gram, key) for every trigram of the rules' queries and row key whose text holds it."""
    grams = sorted({g for r in rules for branch in trigram_query(r.pattern) for g in branch})
    lower = docs.select("key", F.lower("text").alias("text"))
    holds = F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams])
    return lower.select("key", F.explode(F.array_compact(holds)).alias("gram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): bits of the rules whose trigram query the row's postings satisfy."""
    wanted = [(bit, k, len(branch), g) for bit, r in enumerate(rules) for k, branch in enumerate(trigram_query(r.pattern)) for g in branch]
    if not wanted:
        return index.select("key", F.lit(0).alias("rules")).limit(0)
    table = index.sparkSession.createDataFrame(wanted, "rule int, branch int, need int, gram string")
    hit = index.join(F.broadcast(table), "gram").groupBy("key", "rule", "branch", "need").count().where("count = need")
    return hit.groupBy("key").agg(F.expr("bit_or(shiftleft(1, rule))").alias("rules"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (start, kind, end) by start, then kind as listed.

    Places are code points of the text, the end exclusive; ``kind`` is the rule's place in ``rules``. Matches of
    a rule are leftmost and do not overlap; those whose counted group is too short are dropped after that. Null
    texts are empty; ids may be null or repeated (the index is keyed by id and text, so repeated rows share their
    postings); other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    found = candidates(postings(rows, rules), rules)
    rows = rows.join(found, "key", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for bit, rule in enumerate(rules):
        search = Rule(rule.kind, _search_form(rule), rule.group, rule.least)
        may = F.col("rules").bitwiseAND(1 << bit) != 0 if trigram_query(rule.pattern) else F.lit(True)
        spans.append(F.when(may & F.col("text").rlike(search.pattern), _spans(F.col("text"), search, bit)).otherwise(none))
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat(*spans)).alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
