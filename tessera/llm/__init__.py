"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from . import bpe_codec, compression_rules, exact_dedup, filter_audit, importance, language_id, mixing, ngram_join, secret_scan, token_counts, token_file, url_rules, warc_writer

#: One query for each operator, over its whole table with production parameters.
QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_mixing": mixing.op2_mixing,
    "op3_compression_rules": compression_rules.op3_compression_rules,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_bpe_codec": bpe_codec.op5_bpe_codec,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_warc_writer": warc_writer.op7_warc_writer,
    "op8_token_file": token_file.op8_token_file,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_importance": importance.op12_importance,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op4_url_rules": url_rules.ORACLE,
    "op6_secret_scan": secret_scan.ORACLE,
    "op7_warc_writer": warc_writer.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
