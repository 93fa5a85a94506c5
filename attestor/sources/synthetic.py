"""Sound bundles made from a seed, for tests, demonstrations and load.

A scene is a quay: ``berths`` of equal width side by side, and in some of them a
boat of a hull colour and length.  Everything else follows from the layout.
Facts are that a boat is there, its colour, that it is moored, and which boat
lies east of which.  Views are a box around each boat, the west and the east
half, a set of two boxes for each pair of neighbours, and a stop.  A view shows
a fact if the boxes of all boats in it lie within the view's boxes.  Captions
know the facts of the first one, two or all boats.
"""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import dataclass

from attestor.sources.schemas import SCHEMA_VERSION

COLOURS = ("teal", "ochre", "white", "navy", "rust")
REVISION = "quay-views-3"
OBSERVER = "quay-observer-2"


@dataclass(frozen=True)
class Boat:
    berth: int
    colour: str
    length: int


@dataclass(frozen=True)
class Scene:
    name: str
    berths: int
    boats: tuple[Boat, ...]
    split: str = "dev"
    berth_width: int = 16
    height: int = 24

    @property
    def width(self) -> int:
        return self.berths * self.berth_width

    def box(self, boat: Boat) -> list[int]:
        """Half-open pixels of a boat: two from the left edge of its berth, at the foot of the picture."""
        left = boat.berth * self.berth_width + 2
        return [left, self.height - boat.length, left + 11, self.height]


def scenes(seed: int, count: int) -> list[Scene]:
    """``count`` scenes of two to four boats in as many berths or one more."""
    draw, out = random.Random(f"quay/{seed}"), []
    for k in range(count):
        boats = 2 + (seed + k) % 3
        berths = boats + draw.randrange(2)
        places = sorted(draw.sample(range(berths), boats))
        out.append(Scene(f"{seed}/{k}", berths, tuple(Boat(p, draw.choice(COLOURS), draw.randrange(7, 20)) for p in places), ("dev", "train")[k % 2]))
    return out


def opaque(prefix: str, *parts) -> str:
    """A readable name's stable, unreadable id."""
    return f"{prefix}_{hashlib.sha256('|'.join(map(str, parts)).encode()).hexdigest()[:24]}"


def fact_rows(scene: Scene) -> list[dict]:
    """name, kind, boats (numbers), and predicate and object of each fact, west to east."""
    out = []
    for n, boat in enumerate(scene.boats):
        out.append({"name": f"there{n}", "kind": "entity", "boats": (n,), "predicate": "is visible", "literal": "boat"})
        out.append({"name": f"hull{n}", "kind": "attribute", "boats": (n,), "predicate": "has a hull of colour", "literal": boat.colour})
        if boat.length > 12:
            out.append({"name": f"moored{n}", "kind": "action", "boats": (n,), "predicate": "is moored", "literal": "alongside"})
        if n:
            out.append({"name": f"east{n}", "kind": "relation", "boats": (n - 1, n), "predicate": "lies west of", "entity": n})
    return out


def view_rows(scene: Scene) -> list[dict]:
    """name, kind, boxes and score of each view."""
    half, out = scene.width // 2, []
    for n, boat in enumerate(scene.boats):
        out.append({"name": f"boat{n}", "kind": "bbox", "boxes": [scene.box(boat)], "score": round(0.35 + boat.length / 40, 4)})
    for name, box in (("west", [0, 0, half, scene.height]), ("east", [half, 0, scene.width, scene.height])):
        out.append({"name": name, "kind": "bbox", "boxes": [box], "score": 0.3})
    for n in range(1, len(scene.boats)):
        out.append({"name": f"pair{n}", "kind": "region_set", "boxes": [scene.box(b) for b in scene.boats[n - 1 : n + 1]], "score": 0.25})
    return [*out, {"name": "stop", "kind": "stop", "boxes": [], "score": None}]


def context_rows(scene: Scene) -> list[dict]:
    """name, kind, reference and known boats of each caption."""
    every = len(scene.boats)
    return [
        {"name": "first", "kind": "sparse", "reference": None, "boats": 1},
        {"name": "second", "kind": "enriched", "reference": "first", "boats": 2},
        {"name": "again", "kind": "paraphrase", "reference": "second", "boats": 2},
        {"name": "whole", "kind": "saturated", "reference": "second", "boats": every},
    ]


def shows(scene: Scene, view: dict, fact: dict) -> bool:
    """Whether each boat of a fact lies in one of the view's boxes."""

    def within(inner, outer) -> bool:
        return outer[0] <= inner[0] and outer[1] <= inner[1] and inner[2] <= outer[2] and inner[3] <= outer[3]

    return all(any(within(scene.box(scene.boats[n]), b) for b in view["boxes"]) for n in fact["boats"])


def knows(context: dict, fact: dict) -> bool:
    return max(fact["boats"]) < context["boats"]


def _twice(field: str, value: str) -> dict:
    """A label that two annotators agree on."""
    return {field: value, "annotator_ids": ["rater-north", "rater-south"], "annotator_votes": [value, value], "adjudication": value}


def bundle(made: list[Scene]) -> dict[str, list[dict]]:
    """All tables of the scenes but the derived one, as rows of plain values."""
    t: dict[str, list[dict]] = {n: [] for n in ("images", "contexts", "candidates", "observations", "context_metadata", "entities", "facts", "context_fact_labels", "candidate_fact_labels", "observation_claim_labels")}
    prompt = hashlib.sha256(b"say what the view shows").hexdigest()
    for s in made:
        image, sha = opaque("img", s.name), hashlib.sha256(s.name.encode()).hexdigest()
        t["images"].append({"image_id": image, "image_path": f"images/{sha[:12]}.png", "image_sha256": sha, "width": s.width, "height": s.height, "source": "synthetic-quay", "source_image_id": sha[12:24], "duplicate_group_id": opaque("dup", s.name), "split": s.split})
        entity = [opaque("ent", s.name, n) for n in range(len(s.boats))]
        for n, boat in enumerate(s.boats):
            t["entities"].append({"entity_id": entity[n], "image_id": image, "category": "boat", "evidence_regions": [s.box(boat)], "annotation_status": "confirmed"})
        facts, views, contexts = fact_rows(s), view_rows(s), context_rows(s)
        fact_id = {f["name"]: opaque("fact", s.name, f["name"]) for f in facts}
        for f in facts:
            obj = {"entity_id": entity[f["entity"]]} if "entity" in f else {"literal": f["literal"]}
            t["facts"].append({"fact_id": fact_id[f["name"]], "image_id": image, "fact_type": f["kind"], "subject_entity_id": entity[f["boats"][0]], "predicate": f["predicate"], "object": obj, "polarity": "positive", "visual_support": "yes"})
        for c in contexts:
            context = opaque("ctx", s.name, c["name"])
            said = " and ".join(f"a {b.colour} boat" for b in s.boats[: c["boats"]])
            t["contexts"].append({"context_id": context, "image_id": image, "initial_caption": f"At the quay lies {said}.", "source_kind": "generated", "provenance_id": "quay"})
            t["context_metadata"].append({"context_id": context, "context_kind": c["kind"], "context_group_id": opaque("grp", s.name), "reference_context_id": c["reference"] and opaque("ctx", s.name, c["reference"])})
            t["context_fact_labels"] += [{"context_id": context, "fact_id": fact_id[f["name"]], "mention_links": [], **_twice("status", "entailed" if knows(c, f) else "not_entailed")} for f in facts]
        for v in views:
            candidate, seen = opaque("cand", s.name, v["name"]), [f for f in facts if shows(s, v, f)]
            t["candidates"].append({"candidate_id": candidate, "image_id": image, "kind": v["kind"], "boxes": v["boxes"], "proposal_generator_revision": REVISION, "pixel_cost": sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in v["boxes"]), "proposal_score": v["score"]})
            key = json.dumps({"boxes": v["boxes"], "image_sha256": sha, "kind": v["kind"], "observer_revision": OBSERVER, "prompt_hash": prompt}, sort_keys=True, separators=(",", ":"))
            text = "; ".join(f["predicate"] for f in seen) or "nothing of note" if v["boxes"] else ""
            observation = opaque("obs", s.name, v["name"])
            t["observations"].append({"observation_id": observation, "image_id": image, "candidate_id": candidate, "observer_revision": OBSERVER, "prompt_hash": prompt, "cache_key": hashlib.sha256(key.encode()).hexdigest(), "observed_text": text, "output_tokens": len(text.split()), "latency_ms": 3, "status": "ok" if v["boxes"] else "stop"})
            for f in facts:
                visible = f in seen
                label = _twice("sufficient_to_verify", "yes" if visible else "no")
                extent = "full" if visible else "none"
                t["candidate_fact_labels"].append({"candidate_id": candidate, "fact_id": fact_id[f["name"]], "visibility": extent, "visibility_annotator_votes": [extent, extent], "visibility_adjudication": extent, **label})
            for f in seen:
                t["observation_claim_labels"].append({"claim_id": opaque("claim", s.name, v["name"], f["name"]), "observation_id": observation, "mapped_fact_id": fact_id[f["name"]], "claim_text": f["predicate"], **_twice("status", "correct")})
    return t


def provenance() -> dict:
    return {"schema_version": SCHEMA_VERSION, "automatic_candidate_generator_revision": REVISION, "unresolved_cross_split_near_duplicates": []}


def write(root, tables: dict[str, list[dict]], source: dict | None = None) -> str:
    """Write a bundle as JSONL files and its provenance; tables that are not given are empty.  Returns the folder."""
    from pathlib import Path

    from attestor.sources.schemas import GOLD, PUBLIC

    top = Path(root)
    for name in (*PUBLIC, *GOLD):
        at = top / ("public" if name in PUBLIC else "gold") / f"{name}.jsonl"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("".join(json.dumps(row) + "\n" for row in tables.get(name, [])))
    (top / "provenance.json").write_text(json.dumps(provenance() if source is None else source))
    return str(top)
