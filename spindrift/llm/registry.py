"""The registered queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from spindrift.llm import align, forest, html, lines, mixing, packing, phrases, quality, repeats, secrets, simhash, tokenfile, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_html": html.op4_html,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_files": tokenfile.op7_token_files,
    "op8_neighbours": forest.op8_neighbours,
    "op9_repeats": repeats.op9_repeats,
    "op10_secrets": secrets.op10_secrets,
    "op11_align": align.op11_align,
    "op12_lines": lines.op12_lines,
    "op13_phrases": phrases.op13_phrases,
}
SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op12_lines": lines.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
