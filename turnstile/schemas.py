"""Declared output schemas (the reference infers them; we fix them)."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
CONVERSATION = T.ArrayType(TURN)

SHAREGPT_TURN = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("value", T.StringType()),
])

CONVERSATION_TABLE = T.StructType([T.StructField("conversations", CONVERSATION)])

PREFERENCE_TABLE = T.StructType([
    T.StructField("chosen", CONVERSATION),
    T.StructField("rejected", CONVERSATION),
])

TOKEN_STORE = T.StructType([
    T.StructField("doc_idx", T.LongType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("status", T.StringType()),
])

JUDGE_INPUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("response_a", T.StringType()),
    T.StructField("response_b", T.StringType()),
])

JUDGE_RESULT = T.StructType([
    T.StructField("input_text", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("output_text_a", T.StringType()),
    T.StructField("output_text_b", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("individual_rater_scores", T.ArrayType(T.DoubleType())),
    T.StructField("custom_fields", T.StructType([
        T.StructField("explanation", T.StringType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("cleaned_xml", T.StringType()),
    ])),
])

ANSWER = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("answer_id", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("turns", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("tstamp", T.DoubleType()),
])

LEAK_RECORD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
    T.StructField("leak_tokens", T.ArrayType(T.StringType())),
    T.StructField("corrected_token", T.ArrayType(T.StringType())),
    T.StructField("meta", T.StringType()),
])

RUN_LOG = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("total_examples", T.LongType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("model_load_time", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
])
