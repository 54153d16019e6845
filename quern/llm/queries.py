"""Registry of the text operators' queries and of their SQL."""

from __future__ import annotations

from quern.llm import decontaminate, fingerprints, html, licenses, phrases, repeats, resample, warc
from quern.llm.language import op2_language
from quern.llm.packing import op10_pack
from quern.llm.quality import op8_quality
from quern.llm.simhash import op3_simhash
from quern.llm.token_files import op6_token_files

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_main_text": html.op5_main_text,
    "op6_token_files": op6_token_files,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_pack": op10_pack,
    "op11_phrases": phrases.op11_phrases,
    "op12_repeats": repeats.op12_repeats,
    "op13_resample": resample.op13_resample,
}
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op9_warc": warc.ORACLE,
    "op11_phrases": phrases.oracle(),
    "op12_repeats": repeats.oracle(),
    "op13_resample": resample.oracle(),
}
