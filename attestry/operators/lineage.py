"""Provenance graphs: parent chains of bounded depth in tables, and whole stores with relationships, inputs and events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

MAX_DEPTH = 16


# --- parent pointers in a table ------------------------------------------------------------------


def chains(nodes: DataFrame, node: str, parent: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, depth, node, missing, truncated): each node's chain of parents, at most max_depth steps; a cycle ends it as truncated.

    Pointers are doubled: each round joins every node's list of ancestors with that of its last one, so max_depth
    steps take log2(max_depth) rounds; every second one is written, so a plan has a few joins however deep the chains are.
    """
    edges = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"))
    known = edges.select(F.col("id").alias("there"))
    step = lambda i, k: F.struct(i.alias("id"), k.alias("known"))
    lists = edges.join(known, F.col("up") == F.col("there"), "left").select("id", F.when(F.col("up").isNotNull(), F.array(step(F.col("up"), F.col("there").isNotNull()))).otherwise(F.array().cast("array<struct<id:bigint,known:boolean>>")).alias("up"))
    reach, rounds = 1, 0
    while reach < max_depth:
        last = F.get("up", F.lit(reach - 1))
        more = lists.select(F.col("id").alias("next"), F.col("up").alias("more"))
        whole = F.size("up") == reach
        lists = lists.withColumn("last", F.when(whole, last["id"])).join(more, F.col("last") == F.col("next"), "left").select("id", F.when(F.col("more").isNotNull(), F.concat("up", "more")).otherwise(F.col("up")).alias("up"))
        reach, rounds = 2 * reach, rounds + 1
        if rounds % 2 == 0 or reach >= max_depth:
            lists = written(lists, "ancestors")
    way = F.concat(F.array(step(F.col("id"), F.lit(True))), F.slice("up", 1, max_depth))
    # A place ends the chain if its node isn't known, stood there before, or is the last allowed.
    ids = F.transform("way", lambda x: x["id"])
    marked = lambda again: F.transform("way", lambda x, i: F.struct(x["id"].alias("node"), (~x["known"]).alias("missing"), ((i > 0) & (again(x, i) | (i == max_depth))).alias("truncated")))
    whole = lists.select("id", way.alias("way")).withColumn("simple", F.size(F.array_distinct(ids)) == F.size("way"))
    # Few chains meet themselves; only those are searched place by place.
    plain = whole.filter("simple").select("id", marked(lambda x, i: F.lit(False)).alias("marked"))
    loops = whole.filter("not simple").select("id", marked(lambda x, i: F.array_position(ids, x["id"]) <= i).alias("marked"))
    ends = F.transform("marked", lambda x, i: F.when(x["missing"] | x["truncated"], i))
    out = plain.unionByName(loops).withColumn("end", F.array_min(ends))
    out = out.select(F.col("id").alias("start"), F.posexplode(F.slice("marked", F.lit(1), F.coalesce(F.col("end") + 1, F.size("marked")))).alias("depth", "x"))
    return out.select("start", "depth", "x.*")


# --- stores ----------------------------------------------------------------------------------------

# Codes of captures with their wording, of generation, and actions that keep the content.
CAPTURES = {
    "digitalCapture": "camera capture", "computationalCapture": "camera capture", "compositeCapture": "camera capture (composite)", "negativeFilm": "film scan", "positiveFilm": "film scan", "print": "scan of a print", "screenCapture": "screen capture",
}
GENERATIVE = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia")
KEEPING = ("c2pa.opened", "c2pa.transcoded", "c2pa.converted", "c2pa.repackaged")


def found_codes(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, code) of every source type that stands anywhere in a JSON value, in order."""
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}.{k}"
            if isinstance(v, str) and (k == "digitalSourceType" or k.endswith(":DigitalSourceType")):
                yield here, v.strip().rstrip("/").rsplit("/", 1)[-1]
            yield from found_codes(v, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from found_codes(v, f"{path}[{i}]")


def _list(value: object) -> list:
    return value if isinstance(value, list) else []


def _text(value: object, *keys: str) -> str | None:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, str) else None


def events(manifest: dict) -> list[dict]:
    """Actions of a manifest's action assertions, with description, code and agent."""
    out = []
    for a in _list(manifest.get("assertions")):
        if (_text(a, "label") or "").startswith("c2pa.actions") and isinstance(a.get("data"), dict):
            for x in _list(a["data"].get("actions")):
                if (action := _text(x, "action")) is not None:
                    agent = x.get("softwareAgent")
                    name = agent if isinstance(agent, str) else " ".join(y for y in (_text(agent, "name"), _text(agent, "version")) if y) if _text(agent, "name") else None
                    code = _text(x, "digitalSourceType")
                    out.append({"action": action, "description": _text(x, "description"), "code": next((c for _, c in found_codes({"digitalSourceType": code})), None) if code else None, "agent": name})
    return out


def stage(codes: list[str], acts: list[dict]) -> str:
    """A manifest in a few words, by the first of: composite, created or edited by generation, capture, re-encode, its own action."""
    names = [a["action"] for a in acts]
    kept = bool(names) and all(n in KEEPING for n in names)
    if GENERATIVE[1] in codes:
        said = "composite including generative AI"
    elif GENERATIVE[0] in codes:
        said = "generative AI creation" if "c2pa.created" in names else "generative AI edit"
    else:
        said = next((CAPTURES[c] for c in codes if c in CAPTURES), None) or ("re-encode" if kept else next((n.removeprefix("c2pa.") for n in names if n not in KEEPING), "signed record, no actions"))
    marked = any(n.startswith("c2pa.watermarked") for n in names) or any("watermark" in (a["description"] or "").lower() for a in acts)
    return said + " (watermark declared)" * marked


def walk(store: dict, max_depth: int = MAX_DEPTH) -> dict:
    """A store's lineage: steps back from the active manifest, inputs with chains of their own, missing labels, and what follows from them."""
    manifests = store.get("manifests") if isinstance(store.get("manifests"), dict) else {}
    seen: set[str] = set()
    missing: list[str] = []
    inputs: list[dict] = []
    cut = False

    def follow(label: str | None, outer: bool) -> list[dict]:
        nonlocal cut
        steps: list[dict] = []
        while label is not None:
            if len(steps) == max_depth or label in seen:
                cut = True
                break
            seen.add(label)
            m = manifests.get(label)
            if not isinstance(m, dict):
                missing.append(label)
                break
            parent = None
            for x in _list(m.get("ingredients")):
                target, how = _text(x, "active_manifest"), _text(x, "relationship") or "componentOf"
                if target is None:
                    continue
                if how == "parentOf":
                    parent = parent if parent is not None else target  # a second parent isn't followed
                elif outer:
                    inputs.append({"relationship": how, "recorded_at": len(steps), "chain": follow(target, False)})
            acts, codes = events(m), list(dict.fromkeys(c for _, c in found_codes(m)))
            steps.append({"label": label, "depth": len(steps), "codes": codes, "actions": [a["action"] for a in acts], "stage": stage(codes, acts)})
            label = parent
        return steps

    steps = follow(_text(store, "active_manifest"), True)
    makes = [s["depth"] for s in steps if any(c in GENERATIVE for c in s["codes"])]
    capture = lambda some: next((CAPTURES[c] for s in some for c in s["codes"] if c in CAPTURES), None)
    deltas = _list((store.get("validation_results") or {}).get("ingredientDeltas")) if isinstance(store.get("validation_results"), dict) else []
    failed = any(_list(((d if isinstance(d, dict) else {}).get("validationDeltas") or {}).get("failure")) for d in deltas)
    as_input, before = capture([s for i in inputs for s in i["chain"]]), capture([s for s in steps if not makes or s["depth"] > makes[0]])
    doubt = " (earlier steps have failures)" * failed
    if makes:
        line = f"a {as_input} went into generative AI, and this file derives from that{doubt}" if as_input else f"a {before} was edited with generative AI{doubt}" if before else f"this file derives from generative AI; no capture is recorded{doubt}"
    else:
        line = f"a {before}, with no generative step recorded{doubt}" if before else f"a {as_input} went into this file; no generative step is recorded{doubt}" if as_input else None
    said = []
    for s in reversed(steps):
        own = ["(" + " → ".join(x["stage"] for x in reversed(i["chain"])) + ")" for i in inputs if i["recorded_at"] == s["depth"] and i["chain"]]
        said.append((" and ".join(own) + (" was the input to: " if len(own) == 1 else " were the inputs to: ") if own else "") + s["stage"] + " = this file" * (s["depth"] == 0))
    return {
        "n_steps": len(steps), "n_inputs": len(inputs), "relationships": sorted({i["relationship"] for i in inputs}), "missing": missing, "truncated": cut, "generative_depth": makes[0] if makes else None, "declares_ai": bool(makes),
        "parent_codes": list(dict.fromkeys(c for s in steps[1:] for c in s["codes"])), "ingredient_failures": failed, "summary": " → ".join(said) or None, "bottom_line": line, "steps": steps,
    }


WALKED = (
    "n_steps int, n_inputs int, relationships array<string>, missing array<string>, truncated boolean, generative_depth int, declares_ai boolean, parent_codes array<string>, ingredient_failures boolean, summary string, bottom_line string,"
    " steps array<struct<label: string, depth: int, codes: array<string>, actions: array<string>, stage: string>>"
)


def lineage(store: Column, max_depth: int = MAX_DEPTH) -> Column:
    """walk() of a JSON text as a struct (WALKED); nulls for a text that is no JSON object. A store is one row, so its order-dependent walk stays in one place."""

    def one(text: str | None) -> tuple:
        try:
            value = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            value = None
        return tuple(walk(value, max_depth).values()) if isinstance(value, dict) else (None,) * 12

    @F.pandas_udf(WALKED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=[c.split()[0] for c in ("n_steps", "n_inputs", "relationships", "missing", "truncated", "generative_depth", "declares_ai", "parent_codes", "ingredient_failures", "summary", "bottom_line", "steps")], dtype=object)

    return run(store)


def events_of(manifest: Column) -> Column:
    """array<struct<action, description, code, agent>> of a manifest's JSON text; empty for a text that is no JSON object."""

    def one(text: str | None) -> list[dict]:
        try:
            value = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            value = None
        return events(value) if isinstance(value, dict) else []

    @F.pandas_udf("array<struct<action: string, description: string, code: string, agent: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run(manifest)


def timeline(steps: Column) -> Column:
    """A lineage's steps as lines, the oldest first."""
    line = lambda s: F.concat(F.when(s["depth"] == 0, F.lit("this file")).otherwise(F.concat(s["depth"].cast("string"), F.lit(" back"))), F.lit(": "), s["stage"], F.when(F.size(s["codes"]) > 0, F.concat(F.lit(" ["), F.array_join(s["codes"], ", "), F.lit("]"))).otherwise(""))
    return F.array_join(F.transform(F.reverse(steps), line), "\n")


def has_code(buckets: list[Column], code: str) -> Column:
    """Whether any bucket of status codes holds the code."""
    return F.coalesce(F.exists(F.concat(*[F.coalesce(b, F.array().cast("array<string>")) for b in buckets]), lambda c: c == code), F.lit(False))


def rationale(steps: Column, active: Column, generative_depth: Column, missing: Column, truncated: Column, failures: Column) -> Column:
    """Ordered sentences on a lineage, those that apply."""
    return F.concat_ws(
        " ", F.when(F.size(active) > 0, F.concat(F.lit("The active manifest declares "), F.array_join(active, ", "), F.lit("."))).otherwise("The active manifest declares no source type."),
        F.when(generative_depth > 0, F.concat(F.lit("A generative declaration stands "), generative_depth.cast("string"), F.lit(" back."))), F.when(F.size(missing) > 0, F.concat(F.lit("Not in the store: "), F.array_join(missing, ", "), F.lit("."))),
        F.when(truncated, F.concat(F.lit("The walk ended after "), steps.cast("string"), F.lit(" steps."))), F.when(failures, F.lit("Ingredients have validation failures.")),
    )
