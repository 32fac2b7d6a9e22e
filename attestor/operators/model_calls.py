"""Calls of a model at a common rate, and as a table function that SQL can use. The model is a callable that is passed in.

Tasks that share a rate form a barrier stage. In each round they tell each other when they next want to call; all of them
work out the same plan of slots from that, an interval apart, and each waits for its own. A call that fails for a while takes a later slot, so retries
count like first calls, and tasks with much to do take the slots that others don't need.
"""

from __future__ import annotations

import heapq
import inspect
import itertools
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructType

from attestor.operators.extraction import ATTEMPTS, FIRST_WAIT, is_transient

ANSWERS = "request_id string, doc_id string, answer string, error string"
NO_ANSWER = "the model gave no answer"
#: Seconds of slots that a round plans.
ROUND_SECONDS = 1.0
#: Requests that a task holds at once, waiting or answered.
HELD = 256


def plan(now: float, free: float, wants: list[tuple[float | None, int]], interval: float, share: int) -> tuple[float, list[list[float]]]:
    """When the rate is free again, and each task's slots of a round. wants: when each task could call next, None for one that has nothing left, and how many calls it has waiting."""
    start = max(now, free)
    left = [min(n, share) if at is not None and at <= now else 0 for at, n in wants]
    slots: list[list[float]] = [[] for _ in wants]
    while any(left):
        for task, n in enumerate(left):
            if n:
                slots[task].append(start)
                left[task], start = n - 1, start + interval
    return start if any(map(bool, slots)) else free, slots


def paced(prompt: DataFrame, provider: Callable[[str], str | None], per_minute: float, tasks: int = 4, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> DataFrame:
    """request_id, doc_id, answer, error of prompts: one of answer and error for every request.

    The tasks together start at most per_minute calls a minute, and what a second's slots hold more; transient failures are tried again after waits
    that double. Tasks must run at one time: no more than the cluster has cores for, without dynamic allocation.
    """
    interval = 60.0 / per_minute
    share = max(1, int(ROUND_SECONDS / interval / tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, count = BarrierTaskContext.get(), itertools.count()
        me, free, out, waiting = context.partitionId(), 0.0, [], []
        rows = (row for batch in batches for row in zip(*(batch.column(c) for c in ("request_id", "doc_id", "prompt")), strict=True))
        while True:
            for row in itertools.islice(rows, max(0, HELD - len(waiting))):
                heapq.heappush(waiting, (0.0, next(count), 0, *(x.as_py() for x in row)))
            if len(out) >= HELD:
                yield answered(out)
                out = []
            said = [json.loads(x) for x in context.allGather(json.dumps([time.time(), waiting[0][0] if waiting else None, len(waiting)]))]
            now, wants = max(s[0] for s in said), [(s[1], s[2]) for s in said]
            if all(at is None for at, _ in wants):
                break
            free, slots = plan(now, free, wants, interval, share)
            if not any(slots):
                time.sleep(max(0.0, min(at for at, _ in wants if at is not None) - now))
            for slot in slots[me]:
                if waiting[0][0] > slot:  # what is left waits for its next try
                    break
                _, _, tried, request_id, doc_id, text = heapq.heappop(waiting)
                time.sleep(max(0.0, slot - time.time()))
                try:
                    answer = provider(text)
                    out.append((request_id, doc_id, answer, None if answer is not None else NO_ANSWER))
                except Exception as error:  # one failed request must not lose the others
                    if tried + 1 < attempts and is_transient(str(error)):
                        heapq.heappush(waiting, (time.time() + wait * 2**tried, next(count), tried + 1, request_id, doc_id, text))
                    else:
                        out.append((request_id, doc_id, None, str(error)))
        yield answered(out)

    def answered(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["request_id", "doc_id", "answer", "error"])

    return prompt.select("request_id", "doc_id", "prompt").repartition(tasks, F.xxhash64("request_id")).mapInArrow(run, ANSWERS, barrier=True)


# --- answers bound to a schema --------------------------------------------

NAMES = {StringType: "string", DoubleType: "number", LongType: "integer", BooleanType: "boolean"}


def json_schema(kind: DataType) -> dict:
    """The JSON schema of a Spark type, as providers take it to bind an answer."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) | ({"nullable": True} if f.nullable else {}) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": NAMES[type(kind)]}


def mismatch(value: object, kind: DataType, at: str = "answer") -> str | None:
    """Where and how a JSON value isn't of a Spark type; None if it is. Fields that the type doesn't know are let pass."""
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            return f"{at} is no object"
        for f in kind:
            if value.get(f.name) is None:
                if not f.nullable:
                    return f"{at}.{f.name} is missing"
            elif found := mismatch(value[f.name], f.dataType, f"{at}.{f.name}"):
                return found
        return None
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            return f"{at} is no array"
        return next((m for i, v in enumerate(value) if (m := f"{at}[{i}] is missing" if v is None else mismatch(v, kind.elementType, f"{at}[{i}]"))), None)
    right = {StringType: str, DoubleType: (int, float), LongType: int, BooleanType: bool}[type(kind)]
    sound = isinstance(value, right) and (isinstance(value, bool) == (right is bool))
    return None if sound else f"{at} is no {NAMES[type(kind)]}"


def bound_answer(provider: Callable[..., str | None], prompt: str | None, kind: DataType) -> tuple[str | None, str | None]:
    """answer, error: the answer if it is JSON of that type, else what is wrong with it. A provider with a second parameter is given the JSON schema."""
    if prompt is None:
        return None, "there is no prompt"
    try:
        takes = len(inspect.signature(provider).parameters) > 1
        answer = provider(prompt, json_schema(kind)) if takes else provider(prompt)
        if answer is None:
            return None, NO_ANSWER
        problem = mismatch(json.loads(answer), kind)
    except Exception as error:  # as an error of this request
        return None, f"{type(error).__name__}: {error}"
    return (None, problem) if problem else (answer, None)


def ask_model(provider: Callable[..., str | None], kind: DataType):
    """A table function (request_id, prompt) -> (request_id, answer, error), one row for every row that it is given, for spark.udtf.register.

    SELECT a.* FROM requests, LATERAL ask_model(request_id, prompt) a
    """

    class AskModel:
        def eval(self, request_id: str, prompt: str):
            yield (request_id, *bound_answer(provider, prompt, kind))

    return F.udtf(AskModel, returnType="request_id string, answer string, error string")
