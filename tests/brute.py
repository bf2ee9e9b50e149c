"""Plain Python loops the Spark operators are checked against."""

import random


def iou(a, b):
    side_x = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    side_y = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    inter = side_x * side_y
    union = max(0.0, a["w"]) * max(0.0, a["h"]) + max(0.0, b["w"]) * max(0.0, b["h"]) - inter
    return inter / union if union > 0 else 0.0


def boxes(seed, images=6, per_image=14, classes=4, spread=60, scored=True):
    """Random integer boxes with frequent score ties, exact copies and some empty boxes."""
    rng, out = random.Random(seed), []
    for image in range(images):
        count = rng.choice([0, 1, per_image // 2, per_image])
        for pos in range(count):
            box = {
                "image_id": image, "pos": pos, "class_id": rng.randrange(classes), "x": float(rng.randrange(spread)),
                "y": float(rng.randrange(spread)), "w": float(rng.choice([0, 20, 25, 30])), "h": float(rng.choice([20, 25, 30])),
            }
            if out and rng.random() < 0.3 and out[-1]["image_id"] == image:
                box.update({k: out[-1][k] for k in "xywh"})
            if scored:
                box["score"] = rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])
                box["cs"] = [rng.choice([0.0, 0.1, 0.4, 0.9]) for _ in range(classes)]
            out.append(box)
    return out


def by_image(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["image_id"], []).append(row)
    return groups


def suppressed(rows, threshold, score=0.5):
    kept = set()
    for image, group in by_image(rows).items():
        alive = []
        for d in sorted((g for g in group if g["score"] > score), key=lambda d: (-d["score"], -d["pos"])):
            if all(not iou(k, d) > threshold for k in alive):
                alive.append(d)
        kept |= {(image, d["pos"]) for d in alive}
    return kept


def matched(dets, truth, threshold):
    pairs, truth_by = set(), by_image(truth)
    for image, group in by_image(dets).items():
        free = list(truth_by.get(image, []))
        for d in sorted(group, key=lambda d: (-d["score"], d["pos"])):
            best = None
            for g in free:
                value = iou(d, g)
                if value > 0 and (best is None or value > best[0]):
                    best = (value, g)
            if best and best[0] >= threshold:
                pairs.add((image, d["pos"], best[1]["pos"], best[1]["class_id"]))
                free.remove(best[1])
    return pairs


def labelled(dets, truth, threshold):
    """Evaluation rows in order: (y_true, combined scores)."""
    pairs = {(i, p): (g, c) for i, p, g, c in matched(dets, truth, threshold)}
    taken = {(i, g) for i, p, g, c in matched(dets, truth, threshold)}
    rows = []
    for image in sorted({r["image_id"] for r in [*dets, *truth]}):
        for d in sorted((d for d in dets if d["image_id"] == image), key=lambda d: (-d["score"], d["pos"])):
            rows.append((pairs.get((image, d["pos"]), (None, -1))[1], [s * d["score"] for s in d["cs"]]))
        for g in (g for g in truth if g["image_id"] == image):
            if (image, g["pos"]) not in taken:
                rows.append((g["class_id"], [0.0] * 4))
    return rows


def curve(rows, cls):
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1][cls], -i))
    total, tp, out = sum(r[0] == cls for r in rows), 0, []
    for rank, i in enumerate(order, 1):
        tp += rows[i][0] == cls
        out.append((tp / rank, tp / total if total else 0.0, rows[i][1][cls]))
    return out


def ap(points, levels=11):
    grid = [1.0 if i == levels - 1 else i * (1.0 / (levels - 1)) for i in range(levels)]
    return sum(max([p for p, r, _ in points if r >= g], default=0.0) for g in grid) / levels
