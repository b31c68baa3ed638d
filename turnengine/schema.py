"""Types and column lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of the files read and written, in the order in which they stand there.
FLAT_COLUMNS = ["conversazione", "regione", "macro_regione", "languages", "turn_index", "tu_id", "speaker", "italiano", "napoletano", "note"]
SCORE_COLUMNS = ["conversazione", "turn_index", "tu_id", "speaker", "italiano", "gemma", "golden", "bertscore", "bleu", "rouge", "chrf", "similarita", "sostituire", "note"]
FINAL_COLUMNS = [*FLAT_COLUMNS, "fonte", "similarita"]
META_SHEET = ["id", "regione", "macro_regione", "languages", "n_turni_italiani"]
TURN_SHEET = ["turn_index", "tu_id", "speaker", "italiano", "napoletano", "note"]
#: Columns of the metadata file, by header, and what they are called here.
META_HEADERS = {"code": "code", "collection-region": "regione", "macro-region": "macro_regione", "languages": "languages"}
#: Columns a decision file must have.
DECISION_REQUIRED = ["conversazione", "turn_index", "gemma", "golden", "similarita", "sostituire"]

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TURN = _struct(turn_index=_I, tu_id=_S, speaker=_S, italiano=_S, napoletano=_S, note=_S, fonte=_S)
SAMPLE = _struct(id=_S, regione=_S, macro_regione=_S, languages=_S, n_turni_italiani=_I, turni=T.ArrayType(TURN))
CORRECTION = _struct(conversazione=_S, turn_index=_I, ord=_I, old=_S, new=_S)


class EngineError(ValueError):
    """A gate failed: missing input, missing column, unknown code, structural problem."""
