"""Schemas of the records that the engine reads and writes. Keys are parameters elsewhere; (surah, ayat) is their usual form."""

KEYS = ("surah", "ayat")
VERSES = "surah INT, ayat INT, text_id STRING"
VERSES_WITH_THEMES = VERSES + ", theme_paths ARRAY<ARRAY<STRING>>"
SOURCE_TEXT = "id_surah INT, ayat INT, ayat_bahasa_indonesia STRING"
QA = "question STRING, answer STRING, supporting_verses ARRAY<STRUCT<surah:INT,ayat:INT>>, type STRING, difficulty STRING, surah INT, ayat INT, usage BIGINT, status STRING"
QA_SINGLE_PATH = QA.replace("usage BIGINT, ", "") + ", theme_path_used ARRAY<STRING>"
QA_MULTI_PATH = QA.replace("usage BIGINT, ", "") + ", theme_paths ARRAY<ARRAY<STRING>>"
KEY_LIST = "surah INT, ayat INT"
LOG_2 = "surah INT, ayat INT, verdict_A STRING, verdict_B STRING"
LOG_3 = "surah INT, ayat INT, A STRING, B STRING, C STRING"
LOG_5 = LOG_3 + ", D STRING, E STRING"
LABELS = "nama_evaluator STRING, ID STRING, verdict STRING, error_type STRING"
