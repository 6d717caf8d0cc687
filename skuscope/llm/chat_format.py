"""Chat formatting by schema fingerprint (operator 2).

The nested field paths of a table (arrays as ``[]``), restricted to the names that any
layout uses, are hashed; the hash selects a declarative mapping that turns the layout into
canonical turns (conv_id, turn, role, text). Formatting, the loss mask and reading back are
per-turn expressions, so a conversation of any size is never held in one row; only the
digests fold a conversation, streaming through a partition sorted by turn.

Template of a turn: ``<turn ROLE>\\n`` + escaped text + ``</turn>\\n``. In texts a backslash
becomes ``\\b`` and ``<`` becomes ``\\l``; roles also escape ``>`` (``\\g``) and line ends
(``\\n``). So a body never holds a control string and reading back is exact. The loss mask
of a turn is the code-point span of its escaped text if its role is assistant, else empty.

Cases: null text or role counts as empty; a null conv_id is one conversation of its own;
equal turn numbers are ordered by role, then text, null turns first; unknown columns are
ignored (names compare without case); an unknown layout raises ValueError; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind "rows": a row is a turn. kind "list": an array of turns. kind "fields": columns are turns;
#: non-blank parts of one turn are joined by a blank line.
LAYOUTS = [
    {"name": "rows", "kind": "rows", "paths": ["conv_id", "turn", "role", "text"]},
    {"name": "messages", "kind": "list", "paths": ["messages[].role", "messages[].content"], "list": "messages", "role": "role", "text": "content"},
    {"name": "from_value", "kind": "list", "paths": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value"},
    {"name": "instruction_input", "kind": "fields", "paths": ["instruction", "input", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction", "kind": "fields", "paths": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "system_prompt", "kind": "fields", "paths": ["system", "prompt", "response"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt_response", "kind": "fields", "paths": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt_completion", "kind": "fields", "paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question_answer", "kind": "fields", "paths": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a schema, arrays as [], names in lower case."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


_KNOWN = {p for x in LAYOUTS for p in x["paths"]}
_BY_FINGERPRINT = {fingerprint(x["paths"]): x for x in LAYOUTS}


def layout_of(schema: T.StructType) -> dict:
    """Mapping of a schema: by the hash of its known paths, else the widest layout it contains."""
    paths = [p for p in field_paths(schema) if p in _KNOWN]
    found = _BY_FINGERPRINT.get(fingerprint(paths))
    if found is None:
        inside = [x for x in LAYOUTS if set(x["paths"]) <= set(paths)]
        if not inside:
            raise ValueError(f"no layout for {sorted(field_paths(schema))}")
        found = _BY_FINGERPRINT[fingerprint(max(inside, key=lambda x: len(x["paths"]))["paths"])]
    return found


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of any known layout; records without an id column get a running one."""
    names: dict[str, int] = {}
    for i, c in enumerate(df.columns):  # of clashing names the first counts
        names.setdefault(c.lower(), i)
    df = df.toDF(*[c.lower() if names[c.lower()] == i else f"__{i}_{c}" for i, c in enumerate(df.columns)])
    layout = layout_of(df.schema)

    def named(role: Column) -> Column:
        low = F.lower(role)
        out = F.coalesce(role, F.lit(""))
        for alias, name in ROLES.items():
            out = F.when(low == alias, name).otherwise(out)
        return out

    if layout["kind"] == "rows":
        return df.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
    key = F.col(conv_id).cast("long") if conv_id in df.columns else F.monotonically_increasing_id()
    if layout["kind"] == "list":
        df = df.select(key.alias("conv_id"), F.posexplode(layout["list"]).alias("turn", "t"))
        return df.select(
            "conv_id", F.col("turn").cast("long").alias("turn"),
            named(F.col(f"t.{layout['role']}")).alias("role"), F.coalesce(f"t.{layout['text']}", F.lit("")).alias("text"),
        )
    turns = []
    for role, parts in layout["turns"]:
        text = F.concat_ws("\n\n", *[F.when(F.trim(F.col(p).cast("string")) != "", F.col(p).cast("string")) for p in parts])
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    df = df.select(key.alias("conv_id"), F.posexplode(F.array(*turns)).alias("turn", "t"))
    return df.filter("t.role <> 'system' or t.text <> ''").select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


TEXT_ESCAPES = [("\\", "\\b"), ("<", "\\l")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (">", "\\g"), ("\n", "\\n")]


def escape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    return _swap(c, pairs)


def unescape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    return _swap(c, [(b, a) for a, b in reversed(pairs)])


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds formatted, loss_start, loss_length (code points within formatted)."""
    head = F.concat(F.lit("<turn "), escape(F.col("role"), ROLE_ESCAPES), F.lit(">\n"))
    body = escape(F.col("text"))
    out = turns.withColumn("formatted", F.concat(head, body, F.lit("</turn>\n")))
    return out.withColumn("loss_start", F.char_length(head)).withColumn(
        "loss_length", F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0)
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, chars) from formatted turns and their loss spans."""
    pattern = r"(?s)^<turn ([^>]*)>\n([^<]*)</turn>\n$"
    return formatted.select(
        "conv_id", "turn",
        unescape(F.regexp_extract("formatted", pattern, 1), ROLE_ESCAPES).alias("role"),
        unescape(F.regexp_extract("formatted", pattern, 2)).alias("text"),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))).alias("loss_text"),
        F.char_length("formatted").alias("chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, folded over its turns in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        done, key, state = [], None, None

        def close():
            if state is not None:
                n, turns_sha, chars, loss_sha, size = state
                done.append((key, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), size))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            for conv, role, text, loss, chars in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, kind)


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = canonical_turns(table).unionByName(canonical_turns(extra))
    return digests(read_back(format_turns(turns)))
