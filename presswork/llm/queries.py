"""The queries of the operators, by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from presswork.llm import chat, filter_audit, fingerprints, language, mixing, ngram_join, packing, quality, repair, repeats, secret_scan, toxicity, vectors

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_ordinal_quality": quality.op2_ordinal_quality,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_chat_format": chat.op4_chat_format,
    "op5_compression_language": language.op5_compression_language,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_ordinal_toxicity": toxicity.op7_ordinal_toxicity,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_rotated_codes": vectors.op10_rotated_codes,
    "op11_auction_repair": repair.op11_auction_repair,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_novelty": secret_scan.op13_secret_novelty,
}

#: op11's SQL is a dynamic program, op12's counts every order by itself, without a potential. op4's digests follow from the table alone, but for formatted_chars, which the template's escapes add to.
SQL = {
    "op4_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS escaped FROM said
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(escaped + length(role) + 15) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op11_auction_repair": repair.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
