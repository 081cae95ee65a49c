"""Progress of a session, one action at a time: the same step in batch and in streaming.

A step is progress if it brings anything not seen before: a result set with a new id, a product
opened, a subpage, a chosen option, a piece of constraint evidence.  Some kinds are credited only up
to a budget.  The third identical action in a row, six steps without progress, or the last step
allowed end the session, in this order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.rows import spread
from ..functions.text import query_form

# Limits, budgets of credit, page turns, and the ids of products.
MOST_STEPS, REPEATS, IDLE, NEW_IDS = 45, 2, 6, 3
BUDGETS = {"result_set": 3, "product": 5, "subpage": 6}
PAGE_TURNS = ("next >", "< prev")

OUT = "session_id string, pos long, step int, repeats int, idle int, progress array<string>, credited array<string>, reason string, subreason string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in map(str.split, OUT.split(", "))])


def begin() -> dict:
    return {"step": 0, "last": None, "repeats": 0, "idle": 0, "ids": [], "seen": [], "credit": {}}


class Known:
    """The lists of a state with what they hold as sets, so that an action costs what it brings, not what came before."""

    def __init__(self, state: dict):
        self.ids, self.seen = set(state["ids"]), set(state["seen"])


def _is_product(text: str) -> bool:
    return text.isascii() and text.isdigit() and 8 <= len(text) <= 12


def step(state: dict, row: dict, known: Known | None = None) -> dict:
    """Advance the state by an action and tell what came of it; ``known``, if given, goes with the state."""
    known = Known(state) if known is None else known
    name, argument = ((row.get(k) or "").strip().casefold() for k in ("action_name", "action_argument"))
    visible = [str(v) for v in (row["visible_asins"] if row.get("visible_asins") is not None else [])]
    # two searches are the same action if their queries are the same; the name counts as it stands
    said = query_form(row.get("action_argument")) if row.get("action_name") == "search" else argument
    signature = json.dumps([name, said], ensure_ascii=False)
    state["repeats"] = state["repeats"] + 1 if signature == state["last"] else 0
    state["last"] = signature
    state["step"] += 1
    new = [v for v in dict.fromkeys(visible) if v not in known.ids]
    state["ids"] += new
    known.ids.update(new)

    # (kind, key, counts as progress, may be credited)
    found: list[tuple[str, str, bool, bool]] = []
    if visible and (name == "search" or name == "click" and argument in PAGE_TURNS):
        found.append(("result_set", hashlib.sha256("\0".join(visible).encode()).hexdigest(), bool(new), len(new) >= NEW_IDS))
    if name == "click" and _is_product(argument):
        found.append(("product", argument, True, True))
    if name == "click" and visible and row.get("page_type") == "information_subpage":
        found.append(("subpage", f"{visible[0]}:{argument}", True, True))
    if visible:
        options = row.get("selected_options")
        found += [("option", f"{visible[0]}:{a}:{v}", True, True) for a, v in sorted(dict(options).items())] if options else []
    evidence = row.get("constraint_evidence")
    found += [("constraint", str(e), True, True) for e in (evidence if evidence is not None else [])]

    seen, progress, credited = known.seen, [], []
    for kind, key, counts, may in found:
        mark = f"{kind}:{key}"
        if mark in seen:
            continue
        seen.add(mark)
        state["seen"].append(mark)
        if counts:
            progress.append(mark)
            used = state["credit"].get(kind, 0)
            if may and used < BUDGETS.get(kind, 1 << 30):
                state["credit"][kind] = used + 1
                credited.append(mark)
    state["idle"] = 0 if progress else state["idle"] + 1
    if state["repeats"] >= REPEATS:
        why = ("repeat_loop", "exact_action_repeat")
    elif state["idle"] >= IDLE:
        why = ("repeat_loop", "no_progress_loop")
    elif state["step"] >= MOST_STEPS:
        why = ("max_steps", "max_steps")
    else:
        why = (None, None)
    return {"step": state["step"], "repeats": state["repeats"], "idle": state["idle"], "progress": progress, "credited": credited, "reason": why[0], "subreason": why[1]}


def reset_idle(state: dict) -> dict:
    """ST2: a fresh window for repeats and idleness; what was seen stays."""
    return state | {"last": None, "repeats": 0, "idle": 0}


def _run(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
    out, known = [], Known(state)
    for row in rows.sort_values("pos", kind="stable").to_dict("records"):
        out.append({"session_id": row["session_id"], "pos": row["pos"]} | step(state, row, known))
    return pd.DataFrame(out, columns=COLUMNS)


def track(actions: DataFrame) -> DataFrame:
    """ST1 in batch: one row per action (session_id, pos, action_name, action_argument,
    visible_asins, page_type, selected_options, constraint_evidence).  Sessions come one after another in
    sorted partitions, in batches of any cut: a short session costs no frame of its own, a long one is not held whole."""
    rows = spread(actions, "session_id").sortWithinPartitions("session_id", "pos")
    return rows.mapInArrow(_walk, OUT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    session, state, known = None, None, None
    for batch in batches:
        made: dict[str, list] = {c: [] for c in COLUMNS}
        for row in batch.to_pylist():
            if state is None or row["session_id"] != session:
                session, state = row["session_id"], begin()
                known = Known(state)
            for name, value in ({"session_id": session, "pos": row["pos"]} | step(state, row, known)).items():
                made[name].append(value)
        yield pa.RecordBatch.from_pydict(made, schema=SCHEMA)


def track_stream(actions: DataFrame) -> DataFrame:
    """ST1 over a stream: the state of a session lives in the state store, as JSON; rows of a batch
    are taken by position, rows of a later batch come after them."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = json.loads(store.get[0]) if store.exists else begin()
        rows = pd.concat(list(parts), ignore_index=True)
        out = _run(state, rows)
        store.update((json.dumps(state, ensure_ascii=False),))
        yield out

    return actions.groupBy("session_id").applyInPandasWithState(advance, OUT, "state string", "append", "NoTimeout")
