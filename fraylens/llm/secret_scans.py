"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. A scan takes
the (blob, rule version) pairs that the ledger does not hold yet, reads one text
per unseen blob, and joins the findings back to every path that carries it. What
was scanned is returned as the next slice of the ledger, findings or not.

Defined cases: a null text is empty; repeated rows are paths of the same blob; a
null path stays a row of its own; an empty table gives no rows. Positions are
code points, ends exclusive. Matches of a kind are leftmost and do not overlap;
one that is too short is dropped after it has been consumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.llm.common import sha256_hex, staged


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, group ``group`` must have ``least`` characters; ``hint`` is a cheap test that any match passes."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    base: bool = False


# No pattern may look at a long run of letters again from each of its places: texts can be very long.
# Kinds, patterns and least lengths, in the order of their kinds.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", _ASSIGN, 2, 8, r"(?i)(?:passw|secret|token|api_?key)", base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}", base=True),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}", base=True),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32, r"eyJ[A-Za-z0-9_-]"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN "),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D/@:]+:[^\x20\x09-\x0D/@]+@", 0, 1, r"://[^\x20\x09-\x0D/@]+@"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
]
RULE_VERSION = 1

#: Characters of a page when a text is masked.
PAGE = 1024

LEDGER = "blob string, rule_version int, found array<struct<start:int,stop:int,rank:int,kind:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _in_blocks(items: Column) -> Column:
    """The array cut into about as many runs as a run has items, so that appending inside and over runs stays cheap."""
    side = F.ceil(F.sqrt(F.size(items))).cast("int")
    starts = F.sequence(F.lit(0), F.size(items) - 1, side)
    return F.when(F.size(items) == 0, F.array(items)).otherwise(F.transform(starts, lambda at: F.slice(items, at + 1, side)))


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """Spans of one rule; the texts between matches, and the matches, give the positions."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))
        tested = F.transform(found, lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x))
        sizes = F.transform(found, lambda x: F.length(x))
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), sizes.alias("size"), tested.alias("tested"))
        return within(pairs, 2)["out"]

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,rank:int,kind:string>>").alias("out"))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,rank:int,kind:string>>>").alias("out"))

    def span(begin: Column, stop: Column) -> Column:
        return F.struct(begin.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        stop = begin + p["size"]
        kept = F.concat(state["out"], F.array(span(begin, stop)))
        return F.struct(stop.alias("at"), F.when(p["tested"] >= rule.least, kept).otherwise(state["out"]).alias("out"))

    def within(block: Column, depth: int) -> Column:
        if depth == 0:
            return F.aggregate(block, start, step)
        runs = _once(block, lambda each: F.transform(_in_blocks(each), lambda run: within(run, depth - 1)))
        return F.aggregate(runs, outer, over, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))

    def over(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: span(s["start"] + state["at"], s["stop"] + state["at"]))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    return _once(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)


def found_in(text: Column, rules: list[Rule] = RULES) -> Column:
    """All spans by start, then kind as listed."""
    none = F.array().cast("array<struct<start:int,stop:int,rank:int,kind:string>>")
    each = [F.when(text.rlike(r.hint), _spans(text, i, r)).otherwise(none) for i, r in enumerate(rules)]
    ordered = F.sort_array(F.transform(F.concat(*each), lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"])))
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["rank"].alias("rank"), s["kind"].alias("kind")))


def blobs(history: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob) of every version."""
    return history.select(F.col(path).alias("path"), sha256_hex(F.col("text")).alias("blob"))


def scan(history: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", rules: list[Rule] = RULES, version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows).

    ``ledger`` holds the columns of ``LEDGER``; give it the union of all slices
    that earlier scans returned. Findings cover every path of ``history``, from
    whichever scan saw its blob first.
    """
    paths = staged(blobs(history, path))
    by_blob = paths.groupBy("blob").agg(F.min("path").alias("path"))  # any one path will do; copies collapse before the shuffle
    if ledger is not None:
        ledger = ledger.where(F.col("rule_version") == version)
        by_blob = by_blob.join(ledger.select("blob"), "blob", "left_anti")
    asked = by_blob.select(F.col("blob").alias("want"), F.col("path").alias("from_path"))
    texts = history.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("blob", sha256_hex(F.col("text")))
    # Blob and path together: one hot blob is spread over its paths and only the chosen one is read.
    chosen = texts.join(asked, (F.col("blob") == F.col("want")) & F.col("path").eqNullSafe(F.col("from_path")), "left_semi")
    scanned = chosen.select("blob", F.lit(version).alias("rule_version"), found_in(F.col("text"), rules).alias("found"))
    fresh = staged(scanned.dropDuplicates(["blob", "rule_version"]))
    known = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns)).dropDuplicates(["blob"])
    some = known.where(F.size("found") > 0).select(F.col("blob").alias("hit"), "found")
    back = paths.join(some, F.col("blob") == F.col("hit"), "left")
    none = F.array().cast("array<struct<start:int,stop:int,rank:int,kind:string>>")
    return back.select("path", "blob", F.coalesce("found", none).alias("found")), fresh


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``.

    The text is cut into pages once and the spans into runs; a run takes its stretch
    from its pages and its pieces from that, so none is counted out from the start of the text.
    """
    pages = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))
    run_type = "array<struct<at:int,upto:int,spans:array<struct<start:int,stop:int,rank:int,kind:string>>>>"

    def runs_of(each: Column, at: Column) -> Column:
        """Runs of spans, each with the places up to which the text is done before and after it."""
        def bound(state: Column, block: Column) -> Column:
            upto = F.greatest(state["at"], F.array_max(F.transform(block, lambda s: s["stop"])))
            run = F.struct(state["at"].alias("at"), upto.alias("upto"), block.alias("spans"))
            return F.struct(upto.alias("at"), F.concat(state["out"], F.array(run)).alias("out"))

        start = F.struct(at.alias("at"), F.array().cast(run_type).alias("out"))
        return F.aggregate(_once(each, _in_blocks), start, bound)

    def masked(run: Column, stretch: Column, depth: int) -> Column:
        if depth == 0:
            start = F.struct(run["at"].alias("at"), F.array().cast("array<string>").alias("out"))

            def step(state: Column, s: Column) -> Column:
                kept = F.substr(stretch, state["at"] - run["at"] + 1, s["start"] - state["at"])
                longer = F.concat(state["out"], F.array(kept, F.lit(mark)))
                return F.struct(
                    F.greatest(state["at"], s["stop"]).alias("at"),
                    F.when(s["start"] >= state["at"], longer).otherwise(state["out"]).alias("out"),
                )

            return F.aggregate(run["spans"], start, step, lambda s: F.array_join(s["out"], ""))

        def part(inner: Column) -> Column:
            cut = F.substr(stretch, inner["at"] - run["at"] + 1, inner["upto"] - inner["at"])
            return _once(cut, lambda shorter: masked(inner, shorter, depth - 1))

        return F.array_join(F.transform(runs_of(run["spans"], run["at"])["out"], part), "")

    def of_pages(run: Column, leaves: Column) -> Column:
        page = F.floor(run["at"] / PAGE).cast("int")
        several = F.slice(leaves, page + 1, F.floor(run["upto"] / PAGE).cast("int") - page + 1)
        stretch = F.substr(F.array_join(several, ""), run["at"] - page * PAGE + 1, run["upto"] - run["at"])
        return _once(stretch, lambda s: masked(run, s, 1))

    def joined(runs: Column) -> Column:
        done = _once(pages, lambda leaves: F.array_join(F.transform(runs["out"], lambda run: of_pages(run, leaves)), ""))
        return F.concat(done, F.substr(text, runs["at"] + 1))

    return _once(runs_of(spans, F.lit(0)), joined)
