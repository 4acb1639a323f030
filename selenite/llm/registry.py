"""Queries of this folder and their SQL."""

from . import op1_mix, op2_langid, op3_warc, op4_secrets, op5_license, op6_bpe, op7_isomedia, op8_quality, op9_pii, op10_minhash, op11_align, op12_phrases, op13_counts


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix.op1_mix_sources,
        "op2_language_id": op2_langid.op2_language_id,
        "op3_warc_normalise": op3_warc.op3_warc_normalise,
        "op4_secret_scan": op4_secrets.op4_secret_scan,
        "op5_licenses": op5_license.op5_licenses,
        "op6_bpe": op6_bpe.op6_bpe,
        "op7_media_boxes": op7_isomedia.op7_media_boxes,
        "op8_line_frequency": op8_quality.op8_line_frequency,
        "op9_personal_data": op9_pii.op9_personal_data,
        "op10_near_duplicates": op10_minhash.op10_near_duplicates,
        "op11_token_alignment": op11_align.op11_token_alignment,
        "op12_collocations": op12_phrases.op12_collocations,
        "op13_token_counts": op13_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": op1_mix.SQL,
        "op3_warc_normalise": op3_warc.SQL,
        "op8_line_frequency": op8_quality.SQL,
        "op12_collocations": op12_phrases.SQL,
    }
