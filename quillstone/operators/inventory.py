"""Which function answers each row of the operator inventory.

Rows that hold no work on data (settings, locks, surfaces, model calls) are named in OUTSIDE with the reason.
"""

from __future__ import annotations

import importlib

ROWS: dict[str, str] = {
    # scans, sources, sinks
    "S1": "sources.files:listing", "S2": "sources.files:content_at", "S5": "operators.index:resolve_revisions", "S3": "sources.patches:parse_patches", "S4": "sources.patches:parse_patches", "S6": "functions.text:commit_subject", "S7": "operators.lines:grep",
    "S8": "operators.lines:parse_grep", "S9": "sources.patches:parse_patches", "S10": "functions.text:change_type", "S11": "functions.text:language_of", "S12": "sources.files:eval_cases", "S13": "sources.log_blocks:tail", "S14": "sources.log_blocks:lines_of",
    "S15": "operators.filters:point_lookup", "S16": "sources.files:content_at", "S17": "sources.files:append", "S18": "sources.stored:StoredTable", "S19": "sources.stored:StoredTable", "S20": "operators.name_index:NameIndex",
    "S21": "sources.stored:StoredTable", "S22": "sources.stored:cascade", "S23": "sources.files:as_markdown", "S24": "sources.files:cached", "S26": "operators.filters:point_lookup", "S28": "sources.stored:cascade",
    "S29": "sources.stored:StoredTable", "S31": "sources.files:parse_log", "S32": "sources.files:cached",
    # filters and predicates
    "P1": "operators.filters:live", "P2": "operators.filters:of_languages", "P3": "operators.filters:path_matches", "P4": "operators.filters:path_matches", "P5": "operators.filters:name_matches", "P6": "operators.text_index:containing",
    "P7": "operators.filters:overlaps", "P8": "operators.lines:contained", "P9": "functions.text:deserves_vector", "P10": "operators.filters:include_paths", "P11": "operators.lines:reviewable", "P12": "operators.lines:patch_size",
    "P13": "functions.text:is_code_like", "P14": "functions.text:is_prose", "P15": "functions.text:is_literal_query", "P16": "functions.text:is_definition_line", "P17": "functions.text:is_document", "P18": "functions.text:claims_external_code",
    "P19": "functions.text:level_rank", "P20": "operators.filters:in_states", "P21": "operators.filters:scoped_to_tenant", "P22": "functions.text:is_dead_end", "P23": "operators.filters:usable_snapshots", "P24": "operators.filters:git_path_matches",
    "P25": "functions.text:last_segment", "P26": "functions.text:clean_answer", "P27": "functions.text:hunk_range", "P28": "functions.text:known_or",
    # joins
    "J1": "operators.digests:vector_coverage", "J2": "operators.graph:with_symbols", "J3": "operators.digests:reused_vectors", "J4": "operators.graph:neighbours", "J5": "operators.graph:neighbours", "J6": "operators.digests:ready_files",
    "J7": "operators.digests:past_findings", "J8": "operators.digests:vector_coverage", "J9": "operators.digests:missing_chunks", "J10": "operators.index:cascade", "J11": "operators.digests:reused_vectors", "J12": "operators.graph:resolve_edges",
    "J13": "operators.graph:resolve_edges", "J14": "operators.lines:overlap_join", "J15": "operators.lines:contained", "J16": "operators.review:collect_evidence", "J17": "operators.index:chunk_symbols", "J18": "operators.sweep:innermost",
    "J19": "operators.index:tree_diff", "J20": "operators.index:tree_diff", "J21": "operators.index:in_classes", "J22": "operators.review:match_expected", "J23": "operators.review:route_model", "J24": "operators.filters:edges_of",
    # aggregates
    "A1": "operators.digests:files_by_language", "A2": "operators.digests:files_by_directory", "A3": "operators.digests:project_totals", "A4": "operators.digests:index_totals", "A5": "operators.graph:resolved_count", "A6": "operators.graph:edge_kinds",
    "A7": "operators.digests:vector_coverage", "A8": "operators.graph:unique_names", "A9": "operators.graph:singleton_segments", "A10": "operators.digests:latest_feedback", "A11": "operators.digests:reused_vectors", "A12": "operators.digests:severity_totals",
    "A13": "operators.digests:feedback_digest", "A14": "operators.digests:eval_metrics", "A15": "operators.digests:ratio", "A16": "operators.digests:repeated_recall", "A17": "operators.digests:usage", "A18": "operators.digests:unreviewed",
    "A19": "operators.digests:first_seen_order", "A20": "operators.lines:symbol_text", "A21": "operators.lines:reassembled", "A22": "operators.index:build_counters", "A23": "operators.digests:extensions", "A24": "operators.digests:attempt_duration",
    "A25": "operators.digests:fails_gate", "A26": "operators.documents:select_passages", "A27": "operators.lines:hunk_bounds", "A28": "operators.review:discard_counts", "A29": "operators.review:discarded_total", "A30": "operators.lines:diff_totals", "A31": "operators.review:take_within_budget",
    # windows, order, sets
    "W1": "operators.windows:keepers", "W2": "operators.search:reciprocal_rank_fusion", "W3": "operators.windows:latest_per_key", "W4": "operators.windows:directory_spread", "W5": "operators.packing:text_chunks", "W6": "operators.windows:first_per_key",
    "T1": "operators.search:top", "T2": "operators.text_index:containing", "T3": "operators.vector_index:VectorIndex", "T4": "operators.search:reciprocal_rank_fusion", "T5": "operators.sweep:innermost", "T6": "operators.windows:path_order", "T7": "operators.windows:name_order",
    "T8": "operators.search:top", "T9": "operators.graph:with_symbols", "T10": "operators.index:latest_ready", "T11": "operators.windows:page_after", "T12": "operators.digests:recent", "T13": "functions.text:longest_terms", "T14": "operators.documents:select_passages",
    "T15": "operators.review:take_within_budget", "T16": "operators.windows:directory_spread", "T17": "operators.windows:queue_order", "T18": "operators.windows:capped_listing", "T19": "operators.search:top",
    "U1": "operators.search:reciprocal_rank_fusion", "U2": "operators.search:expanded_search", "U3": "functions.text:longest_terms", "U4": "operators.digests:unreviewed", "U5": "operators.documents:select_passages",
    # retrieval
    "R1": "functions.text:search_text", "R2": "functions.text:search_text", "R3": "operators.search:postings", "R4": "functions.text:clean_terms", "R5": "functions.text:longest_terms", "R6": "operators.text_index:staged", "R7": "operators.text_index:rank_terms",
    "R8": "operators.search:cover_rank", "R9": "operators.deadline:within", "R10": "operators.vector_index:VectorIndex", "R11": "operators.search:reciprocal_rank_fusion", "R12": "operators.search:by_staged_terms", "R13": "operators.lines:overlap_join", "R14": "operators.filters:path_matches",
    "R15": "operators.filters:name_matches", "R16": "operators.navigation:describe", "R17": "operators.navigation:outline", "R18": "operators.lines:reassembled", "R19": "operators.graph:neighbours", "R20": "operators.graph:neighbours", "R21": "operators.graph:edge_kinds",
    "R22": "operators.navigation:TOOLS", "R23": "operators.navigation:resolve_path", "R24": "operators.navigation:suggest_paths", "R25": "operators.navigation:search_documents", "R26": "operators.navigation:rendered", "R27": "operators.navigation:diff_context",
    "R28": "operators.review:take_within_budget", "R29": "functions.text:expansion_terms", "R30": "operators.search:expanded_search", "R31": "functions.text:plain_text", "R32": "functions.text:split_passages", "R33": "operators.documents:select_passages",
    "R34": "operators.documents:select_passages", "R35": "operators.navigation:grep_windows", "R36": "operators.navigation:search_documents", "R37": "functions.text:result_limit", "R38": "operators.index:choose_backends", "R39": "operators.digests:index_state", "R40": "operators.lines:windows_around",
    "R41": "operators.digests:past_findings", "R42": "operators.documents:select_passages", "R43": "operators.lines:unified_patch", "R44": "operators.navigation:TOOLS", "R45": "operators.navigation:rendered",
    # ingestion and dataflow
    "I1": "operators.index:tree_diff", "I2": "operators.parsing:symbols", "I3": "functions.text:module_path", "I4": "operators.parsing:edges", "I5": "operators.scripts:symbols", "I6": "operators.packing:text_chunks", "I7": "operators.parsing:symbols", "I8": "operators.parsing:chunks",
    "I9": "functions.text:breadcrumb", "I10": "functions.text:content_hash", "I11": "operators.graph:replace_edges", "I12": "operators.name_index:NameIndex", "I13": "operators.review:moved_state", "I15": "operators.index:insert_missing", "I16": "operators.digests:missing_chunks",
    "I17": "operators.digests:reused_vectors", "I18": "operators.digests:check_dimensions", "I19": "operators.digests:index_state", "I20": "operators.index:needs_build", "I21": "operators.index:replace_children", "I22": "operators.index:apply_tree", "I23": "operators.index:pick_up", "I24": "operators.index:nested",
    "I25": "operators.parsing:edges", "I26": "operators.lines:overlap_join", "I27": "operators.scripts:symbols",
    "D1": "functions.text:added_code", "D2": "operators.lines:unified_patch", "D3": "operators.lines:find_by_path", "D4": "operators.lines:content_window", "D5": "functions.text:dedup_key", "D6": "operators.review:plan_mode", "D7": "operators.review:fan_out", "D8": "operators.review:merge_drafts",
    "D9": "operators.review:outcome", "D10": "operators.review:collect_evidence", "D11": "operators.review:judged", "D12": "operators.review:add_findings", "D13": "operators.review:failure_kind", "D14": "operators.review:run_outcome", "D15": "operators.digests:status_after",
    "D16": "operators.review:route_model", "D17": "operators.review:match_expected", "D18": "operators.index:insert_missing", "D19": "operators.windows:last_messages", "D20": "operators.filters:include_paths", "D21": "operators.review:restarted", "D22": "operators.digests:status_after",
    "D23": "operators.lines:patch_size", "D27": "operators.review:judged", "D28": "operators.review:route_model", "D29": "operators.digests:repeated_recall", "D30": "operators.review:match_expected",
    # streams
    "X1": "streaming.steps:with_cursor", "X2": "streaming.tail:live_tail", "X3": "streaming.tail:live_tail", "X4": "streaming.steps:envelope", "X5": "operators.windows:page_after", "X7": "operators.review:fan_out", "X10": "operators.search:expanded_search", "X11": "streaming.steps:encode", "X12": "streaming.steps:record",
}

OUTSIDE: dict[str, str] = {
    "S25": "a network surface over the functions here", "S27": "adaptive execution has run-time statistics", "S30": "runs a program",
    "I12b": "the table form I12 is the canonical one", "I14": "batching of transactions has no counterpart", 
    "D24": "calls a model; its failures are rows of D13", "D25": "calls a model; its failures are rows of D13", "D26": "composition of the functions of operators.review", "X6": "a lock; one query writes a stream", "X8": "a retry timer", "X9": "partial answers of a model",
}


#: Queries of rows that no query is named after: the query runs the function of the row.
VIA: dict[str, str] = {
    "S3": "s9_parse_patches", "S4": "s9_parse_patches", "W5": "i6_text_chunks", "A31": "r28_budget", "T15": "r28_budget", "S19": "s18_insert_missing", "S20": "i12_resolve_edges", "S21": "i11_replace_edges", "S28": "s22_cascade", "S29": "s18_insert_missing", "P1": "p3_path_match", "P4": "p3_path_match", "P25": "p5_t7_find_by_name",
    "J1": "a7_coverage", "J2": "r19_callers", "J3": "i17_reused_vectors", "J4": "r19_callers", "J5": "r19_callers", "J7": "r41_past_findings", "J8": "a7_coverage", "J9": "i16_missing_chunks", "J10": "s22_cascade", "J11": "i17_reused_vectors",
    "J12": "i12_resolve_edges", "J13": "i12_resolve_edges", "J19": "j20_i1_tree_diff", "J23": "d16_route_model", "A11": "i17_reused_vectors", "A26": "r33_r34_select_passages", "W2": "r11_hybrid_search", "T1": "r7_r8_cover_rank",
    "T2": "r6_staged_search", "T3": "r10_vector_search", "T4": "r11_hybrid_search", "T5": "j18_innermost", "T9": "r19_callers", "T14": "r33_r34_select_passages", "T19": "t12_recent", "U1": "r11_hybrid_search", "U2": "r30_expanded_search",
    "U3": "r4_r5_terms", "U4": "a18_unreviewed", "U5": "r33_r34_select_passages", "R2": "r1_search_text", "R39": "i19_index_state", "R42": "r33_r34_select_passages", "R44": "r22_search_code", "I3": "i5_i27_script_symbols",
    "I15": "s18_insert_missing", "D18": "s18_insert_missing", "D22": "d15_status", "D28": "d16_route_model", "D29": "a16_repeated_recall", "D30": "d17_j22_match_expected", "X5": "t11_keyset_page", "X10": "r30_expanded_search",
}
#: Rows that write files or streams; tests run them on folders of their own.
WRITERS = ("S17", "X12")


def queries_of(row: str, names) -> list[str]:
    """Queries that run the function of a row, of the given names."""
    return [q for q in names if row.lower() in q.split("_")] or [q for q in names if q == VIA.get(row)]


def resolve(row: str):
    """The object that answers a row."""
    module, name = ROWS[row].split(":")
    return getattr(importlib.import_module(f"quillstone.{module}"), name)
