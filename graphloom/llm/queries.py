"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm import decontaminate, pii
from graphloom.llm.decontaminate import op5_decontaminate
from graphloom.llm.langid import op6_langid
from graphloom.llm.licenses import op7_licenses
from graphloom.llm.media import op1_media
from graphloom.llm.packing import op4_packing
from graphloom.llm.pii import op3_pii
from graphloom.llm.quality import op2_quality
from graphloom.llm.secret_scan import op10_secrets
from graphloom.llm.simhash import op9_simhash
from graphloom.llm.token_counts import op8_token_counts

QUERIES = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_licenses": op7_licenses,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op3_pii": pii.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
}
