"""The review dataflow: drafts are merged, verified against evidence and accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as K
from quillstone.functions import text as T
from quillstone.operators.snippets import first_sources
from quillstone.operators.spread import met, spread_join
from quillstone.storage import kept

AGENTIC_CHARS = 12_000


def quotes() -> Column:
    """What a draft quotes, as it is written."""
    return F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("code_fragment") != "", F.col("code_fragment")))))


def collect_evidence(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """(draft_id, snippet, source_no, kind): snippets that some source of the file contains, by the first such source. [D10, J16]

    drafts(draft_id, file_path, evidence, code_fragment); sources(file_path, source_no, kind, text). Distinct snippets and
    sources of a file meet by the hashes of their windows, not by a theta join.
    """
    asked = drafts.select("draft_id", "file_path", F.explode(F.array_distinct(F.transform(quotes(), T.normal_space))).alias("snippet")).filter("snippet <> ''")
    # Read twice: by the match and by the drafts that get its result.
    asked = kept(asked, "asked")
    held = sources.select("file_path", "source_no", "kind", T.normal_space(F.col("text")).alias("text"))
    found = first_sources(asked, held)
    # Most drafts of a file may quote the same code.
    return spread_join(asked, found, ["file_path", "snippet"], "draft_id").select("draft_id", "snippet", "source_no", "kind")


def proofs(quoted: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_path, quotes, has_evidence, cited): quotes of a file that have evidence, each once however many drafts make them.

    quoted(file_path, evidence, code_fragment), sources as in collect_evidence.
    """
    told = kept(quoted.select("file_path", quotes().alias("quotes")).filter("file_path IS NOT NULL").distinct(), "quotes")
    each = told.select(F.struct("file_path", "quotes").alias("draft_id"), "file_path", F.col("quotes").alias("evidence"), F.lit(None).cast("string").alias("code_fragment"))
    return proven_by(collect_evidence(each, sources)).select("draft_id.*", "has_evidence", "cited")


def proven_by(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("draft_id").agg(F.lit(True).alias("has_evidence"), F.max(F.col("kind") == "retrieved_chunk").alias("cited"))


def of_files(hunks: DataFrame, shown: DataFrame) -> DataFrame:
    """(file_path, _ranges, _shown): the hunks of a file as one row, so drafts meet them once."""
    ranges = hunks.groupBy("file_path").agg(F.collect_set(F.struct("first", "last")).alias("_ranges"))
    seen = shown.select("file_path", F.lit(True).alias("_shown")).distinct()
    return ranges.join(seen, "file_path", "full").filter("file_path IS NOT NULL")


def weighed(drafts: DataFrame) -> DataFrame:
    """Drafts beside their file and proof -> covers_line, has_evidence, proven and confirmable in their stead."""
    covers = F.exists("_ranges", lambda h: (F.col("line_start") <= h["last"]) & (F.col("line_end") >= h["first"]))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = drafts.withColumn("covers_line", F.coalesce(covers, F.lit(False))).drop("_ranges").withColumn("has_evidence", no("has_evidence"))
    out = out.withColumn("proven", ~T.claims_external_code(F.col("title"), F.col("body")) | no("cited") | no("_shown"))
    return out.withColumn("confirmable", F.col("has_evidence") & F.col("proven")).drop("cited", "_shown")


def judged(drafts: DataFrame, evidence: DataFrame, hunks: DataFrame, shown: DataFrame) -> DataFrame:
    """Drafts with covers_line, has_evidence, proven and confirmable. [D11, D27, J15]

    hunks(file_path, first, last); shown(file_path): files for which code outside the patch was shown.
    """
    # A file may have most of the drafts.
    return weighed(spread_join(drafts, of_files(hunks, shown), ["file_path"], "draft_id", "left").join(proven_by(evidence), "draft_id", "left"))


def merge_drafts(drafts: DataFrame, keys=("run_id", "dedup_key"), seq: str = "seq") -> DataFrame:
    """Of each key the draft that stands best, the first of equals; the others are displaced. [D8]"""
    best = [F.desc("covers_line"), F.desc("confirmable"), F.desc(T.severity_rank(F.col("severity"))), F.col(seq)]
    return drafts.withColumn("displaced", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)) > 1)


def outcome() -> Column:
    """What becomes of a judged and merged draft. [D9, A28]"""
    return (
        F.when(~F.col("covers_line"), "outside_diff")
        .when(F.col("displaced"), F.when(F.col("confirmable"), "duplicate").when(F.col("has_evidence"), "unproven").otherwise("without_evidence"))
        .when(~F.col("has_evidence"), "without_evidence").when(~F.col("proven"), "unproven").otherwise("finding")
    )


def verify(drafts: DataFrame, sources: DataFrame, hunks: DataFrame, shown: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
    """Drafts with their key, outcome and all that led to it. [D5, D8-D11]

    Drafts meet what is known of their file and of their quotes; where both are small, drafts stay in place until they are merged,
    and drafts that lie together by run do so then as well. quoted: rows that hold all quotes of the drafts, if these cost less to read.
    """
    keyed = drafts.withColumn("dedup_key", T.dedup_key(F.col("category"), F.lit(None).cast("string"), F.col("anchor_symbol"), F.col("file_path"), F.coalesce(F.nullif(F.col("code_fragment"), F.lit("")), F.col("title"))))
    beside = met(keyed.withColumn("quotes", quotes()), kept(of_files(hunks, shown), "files"), ["file_path"], "draft_id")
    beside = met(beside, kept(proofs(drafts if quoted is None else quoted, sources), "proofs"), ["file_path", "quotes"], "draft_id")
    return merge_drafts(weighed(beside.drop("quotes"))).withColumn("outcome", outcome())


def discard_counts(verified: DataFrame) -> DataFrame:
    """[A28]"""
    reasons = ("outside_diff", "without_evidence", "unproven", "duplicate")
    return verified.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == r).alias(r) for r in reasons], F.count_if(F.col("outcome") == "finding").alias("findings"))


def discarded_total(counts: DataFrame) -> DataFrame:
    """Counts per run with their sum over the four reasons. [A29]"""
    return counts.withColumn("discarded", F.col("outside_diff") + F.col("without_evidence") + F.col("unproven") + F.col("duplicate"))


def add_findings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh findings whose key the run has not. [D12, S18]"""
    return fresh.join(stored.select("run_id", "dedup_key"), ["run_id", "dedup_key"], "left_anti").dropDuplicates(["run_id", "dedup_key"])


def plan_mode(hunks: DataFrame, agentic: bool, others: tuple[str, ...] = ("single_pass",)) -> DataFrame:
    """Reviewer of each file by the size of its patch. [D6]"""
    size = hunks.groupBy("path").agg(F.sum(F.length("patch_text")).alias("chars"))
    fallback = F.lit(others[0]) if others else F.lit("agentic") if agentic else F.lit(None).cast("string")
    return size.withColumn("mode", F.when((F.col("chars") <= AGENTIC_CHARS) & F.lit(agentic), "agentic").otherwise(fallback))


def fan_out(files: DataFrame, reviewers: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Tasks of every file and reviewer of its mode, without those done before. [D7, X7]"""
    tasks = files.join(reviewers, "mode")
    return tasks if done is None else tasks.join(done.select("path", "reviewer"), ["path", "reviewer"], "left_anti")


def run_outcome(runs: DataFrame) -> DataFrame:
    """runs(run_id, failures, files_read) -> status. [D14]"""
    return runs.withColumn("status", F.when((F.col("failures") > 0) & (F.col("files_read") == 0), "failed").otherwise("completed"))


def failure_kind(error: Column, table: dict[str, str], other: str = "unknown") -> Column:
    """First matching class of an error name. [D13]"""
    out = None
    for name, kind in table.items():
        out = F.when(F.contains(error, F.lit(name)), kind) if out is None else out.when(F.contains(error, F.lit(name)), kind)
    return F.lit(other) if out is None else out.otherwise(other)


def moved_state(status: Column, asked: Column, terminal=K.TERMINAL_RUN) -> Column:
    """The state after a transition; a terminal one stays. [I13, D21]"""
    return F.when(status.isin(*terminal), status).otherwise(asked)


def restarted(runs: DataFrame) -> DataFrame:
    """Restartable runs queued again: one attempt more, counters cleared. [D21]"""
    may = F.col("status").isin(*K.RESTARTABLE_RUN)
    out = runs.withColumn("attempt", F.col("attempt") + may.cast("int"))
    for c in ("duration_ms", "tokens_input", "tokens_output", "cost_usd", "files_with_context"):
        out = out.withColumn(c, F.when(may, F.lit(0)).otherwise(F.col(c)))
    return out.withColumn("status", F.when(may, "queued").otherwise(F.col("status")))


def route_model(requests: DataFrame, models: list[tuple[str, bool, int]]) -> DataFrame:
    """Model of each request by priority: the named one, a local one, an allowed remote one, any local. [D16, D28, J23]

    requests(request_id, named, min_level, deep, allow_remote); models: (name, is_local, level), a short list of settings.
    """

    def choice(name: str, is_local: bool, level: int) -> Column:
        fits = F.col("min_level") <= level
        rank = F.when((F.col("named") == name) & fits, 0)
        if is_local:
            rank = rank.when(fits & ~F.col("deep"), 1).otherwise(3)
        else:
            rank = rank.when(F.col("allow_remote") & fits, 2)
        return F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.lit(name).alias("model")))

    best = F.array_min(F.array_compact(F.array(*[choice(*m) for m in models])))["model"] if models else F.lit(None).cast("string")
    return requests.select("request_id", best.alias("model"))


def match_expected(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Outcome of each case: found if a finding holds any keyword. [J22, D17, D30]

    cases(name, keywords, category, min_severity); findings(name, title, body, severity, category).
    """
    body = F.lower(F.concat_ws(" ", "title", "body"))
    f = findings.select("name", body.alias("_body"), F.col("severity").alias("_sev"), F.col("category").alias("_cat"))
    both = cases.join(f, "name", "left")
    hit = F.coalesce(F.exists("keywords", lambda k: F.contains(F.col("_body"), F.lower(k))), F.lit(False))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return both.withColumn("_hit", hit).groupBy("name").agg(
        (F.first(F.size("keywords")) == 0).alias("is_clean"), F.max("_hit").alias("found"), F.count("_body").alias("findings"),
        F.max(F.col("_hit") & ok(T.severity_rank(F.col("_sev")) >= T.severity_rank(F.col("min_severity")))).alias("severity_ok"),
        F.max(F.col("_hit") & ok(F.col("_cat") == F.col("category"))).alias("category_ok"),
    )


def take_within_budget(pieces: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Per key: pieces taken in order while they fit; later smaller ones may still fit. [R27, R28, A31, T15]

    pieces(key, piece_id, tokens, ...). A fold over each key's sorted array of small structs; repeats of a piece count once.
    """
    one = pieces.groupBy(key, "piece_id").agg(F.min(F.struct(*order, "tokens")).alias("_x"))
    listed = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"_x.{c}").alias(c) for c in order], F.col("piece_id"), F.col("_x.tokens").alias("tokens")))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"), F.lit(0).alias("dropped"))

    def step(acc: Column, p: Column) -> Column:
        fits = acc["used"] + p["tokens"] <= limit
        return F.struct(
            F.when(fits, acc["used"] + p["tokens"]).otherwise(acc["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(p["piece_id"].cast("string")))).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["dropped"]).otherwise(acc["dropped"] + 1).alias("dropped"),
        )

    return listed.select(key, F.aggregate("_all", start, step).alias("_a")).select(key, "_a.used", "_a.taken", "_a.dropped")
