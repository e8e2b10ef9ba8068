"""Chat formatting by token-level assembly.

Role and text of a turn are encoded apart from each other, so no token spans two segments. Reserved
ids, which no text can produce, mark the turns: START role SEP text END. The loss mask is the
running sum of +1 after the SEP of a trained role and -1 at its END. A control string that occurs
in a role or text is escaped (its first character is followed by a backslash-like mark), so that
the rendered text of a conversation parses back to its turns, too.

Conversations are read by turn; turns of equal number by role, then text. Encoding and reading back,
which are the work, are done turn by turn where the rows lie. What was read back is shuffled, the text
once, and streamed in order through a task that holds running digests only, so that a conversation of
any length can pass.

Defined results: null text and null role are empty; a null turn comes first; null is a conversation
of its own; repeated rows are turns of their own; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import slices, table

#: Ids above the vocabulary's, and how they are rendered.
START, SEP, END = 50257, 50258, 50259
CONTROL = {START: "<|turn|>", SEP: "<|text|>", END: "<|end|>"}
TRAINED = ("assistant",)
#: Other templates' control strings, which are escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
MARK = "\\"

_STRINGS = sorted({*CONTROL.values(), *FOREIGN}, key=len, reverse=True)
_ESCAPE = re.compile("|".join(f"{re.escape(s[0])}{re.escape(MARK)}*{re.escape(s[1:])}" for s in _STRINGS))
_UNESCAPE = re.compile("|".join(f"{re.escape(s[0])}{re.escape(MARK)}+{re.escape(s[1:])}" for s in _STRINGS))


def escape(text: str) -> str:
    """Put one more mark after the first character of each control string, marked or not."""
    return _ESCAPE.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    """Take one mark away again."""
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


@functools.lru_cache(maxsize=2)
def _encoder(path: str | None):
    from tilewright.llm.bpe import shared

    return shared(path, False)


def assemble(role: str | None, text: str | None, vocabulary: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and the change of the loss mask at each: a prefix sum gives the mask."""
    encode = _encoder(vocabulary).encode
    head, body = encode(escape(role or "")), encode(escape(text or ""))
    ids = np.concatenate([[START], head, [SEP], body, [END]]).astype(np.uint32)
    delta = np.zeros(len(ids), np.int8)
    if role in TRAINED and len(body):
        delta[len(head) + 2] += 1
        delta[-1] -= 1
    return ids, delta


def formatted(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, ids and loss (a mask of the same length)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            ids, masks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                a, delta = assemble(role, text, vocabulary)
                ids.append(a.astype("<u4").tobytes())
                masks.append(np.cumsum(delta, dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["conv_id", "turn", "role", "text", "ids", "loss"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss binary")


def render(ids: np.ndarray, vocabulary: str | None = None) -> str:
    """The formatted text of ids, control strings included."""
    decode, out = _encoder(vocabulary).decode, []
    at = np.flatnonzero(ids >= START)
    start = 0
    for k in at:
        out += [decode(ids[start:k]), CONTROL[int(ids[k])]]
        start = k + 1
    return "".join([*out, decode(ids[start:])])


def read_back(ids: np.ndarray, loss: np.ndarray, vocabulary: str | None = None) -> tuple[str, str, str, int]:
    """Of one turn's ids and mask: role, text, what the mask covers (all unescaped) and the rendered length."""
    decode = _encoder(vocabulary).decode
    a, b, c = (int(np.flatnonzero(ids == x)[0]) for x in (START, SEP, END))
    role, text = decode(ids[a + 1 : b]), decode(ids[b + 1 : c])
    masked = ids[loss > 0]
    learned = unescape(decode(masked[masked < START]))
    chars = len(role) + len(text) + sum(map(len, CONTROL.values()))
    return unescape(role), unescape(text), learned, chars


def turns_read_back(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """From formatted(): conv_id, turn, and as read from ids and mask: role, text, learned (null where it is the whole text), chars."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            rows = []
            for ids, loss in zip(batch.column("ids").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                role, text, learned, chars = read_back(np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.int8), vocabulary)
                rows.append((role, text, None if learned == text else learned, chars))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            told = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *told], names=["conv_id", "turn", "role", "text", "learned", "chars"])

    return turns.mapInArrow(run, "conv_id long, turn long, role string, text string, learned string, chars long")


def digests(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """From formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, done = None, []

        def told():
            cols = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def close():
            if now:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, role, text, learned, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "learned", "chars")), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                learned = text if learned is None else learned
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(learned)
                now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += chars
            yield told()
        close()
        yield told()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns_read_back(turns, vocabulary).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(formatted(given.unionByName(own)))


def _marks(column: str) -> str:
    """DuckDB: how many marks escape() puts into a column."""
    pattern = _ESCAPE.pattern.replace("'", "''")
    return f"len(regexp_extract_all({column}, '{pattern}'))"


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + {_marks("role")} + {_marks("text")} + {sum(map(len, CONTROL.values()))}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
