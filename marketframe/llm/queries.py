"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from marketframe.llm import importance, phrases, sharding
from marketframe.llm.decontamination import op5_decontamination
from marketframe.llm.jaccard_join import op10_jaccard_join
from marketframe.llm.language_id import op9_language_id
from marketframe.llm.mixing import op2_mixing
from marketframe.llm.nn_descent import op8_nn_descent
from marketframe.llm.personal_data import op7_personal_data
from marketframe.llm.repetition import op13_repetition
from marketframe.llm.token_counts import op6_token_counts
from marketframe.llm.token_files import op1_token_files
from marketframe.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_personal_data": op7_personal_data,
    "op8_nn_descent": op8_nn_descent,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_phrases": phrases.op12_phrases,
    "op13_repetition": op13_repetition,
}

ORACLE: dict[str, str] = {
    "op4_sharding": sharding.oracle_sql(),
    "op11_importance_resampling": importance.oracle_sql(),
    "op12_phrases": phrases.oracle_sql(),
}
