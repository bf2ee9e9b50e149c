"""Query registry and the DuckDB text shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import Fixtures, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9
NUDGE = 1e-12


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``; real columns are rounded on both sides."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Fixtures(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    reals = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    # The nudge takes values off exact halves, which the engines round differently; adding 0 turns -0 into 0.
    return df.withColumns({n: F.round(F.col(n).cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0) for n in reals}) if reals else df


def duck(body: str, fixtures=(), ctes=(), reals: str = "") -> str:
    """One DuckDB statement: fixture relations, further ``name as (...)`` items, body; ``reals`` are rounded."""
    items = [*with_clause(*fixtures), *ctes]
    head = f"with recursive {', '.join(items)} " if items else ""
    names = reals.split()
    if names:
        swaps = ", ".join(f"round({n} + {NUDGE!r}, {DIGITS}) + 0.0 as {n}" for n in names)
        body = f"select * replace ({swaps}) from ({body}) _out"
    return head + body


def iou(a: str, b: str, form: str = "xywh") -> str:
    """IoU text for two aliases, NULL where either box is missing."""
    if form == "xywh":
        x2a, y2a, x2b, y2b = f"({a}x+{a}w)", f"({a}y+{a}h)", f"({b}x+{b}w)", f"({b}y+{b}h)"
        x1a, y1a, x1b, y1b = f"{a}x", f"{a}y", f"{b}x", f"{b}y"
        wa, ha, wb, hb = f"{a}w", f"{a}h", f"{b}w", f"{b}h"
    else:
        x1a, y1a, x2a, y2a = (f"{a}{c}" for c in ("x1", "y1", "x2", "y2"))
        x1b, y1b, x2b, y2b = (f"{b}{c}" for c in ("x1", "y1", "x2", "y2"))
        wa, ha, wb, hb = f"({x2a}-{x1a})", f"({y2a}-{y1a})", f"({x2b}-{x1b})", f"({y2b}-{y1b})"
    zero = "cast(0 as double)"
    inter = (
        f"greatest({zero}, least({x2a},{x2b})-greatest({x1a},{x1b}))"
        f"*greatest({zero}, least({y2a},{y2b})-greatest({y1a},{y1b}))"
    )
    union = f"(greatest({zero},{wa})*greatest({zero},{ha})+greatest({zero},{wb})*greatest({zero},{hb})-{inter})"
    return f"(case when {x1a} is null or {x1b} is null then null when {union}>0 then {inter}/{union} else {zero} end)"


def cte_nms(thresholds, source: str = "fx_det", out: str = "kept") -> list[str]:
    """``out``: rows of ``source`` kept at every threshold ``t``, by a step-by-step recursion in score order."""
    values = ", ".join(f"(cast({t} as double))" for t in thresholds)
    box = "struct_pack(pos := r.pos, x := r.x, y := r.y, w := r.w, h := r.h)"
    clash = f"len(list_filter(n.kept, lambda k: {iou('k.', 'r.')} > n.t)) > 0"
    return [
        f"{out}_thr(t) as (values {values})",
        f"{out}_rk as materialized (select t, d.*, row_number() over (partition by t, image_id order by score desc, pos desc) rk "
        f"from {source} d, {out}_thr)",
        f"{out}_step(t, image_id, rk, kept) as (select r.t, r.image_id, r.rk, [{box}] from {out}_rk r where rk = 1 union all "
        f"select n.t, n.image_id, r.rk, case when {clash} then n.kept else list_append(n.kept, {box}) end "
        f"from {out}_step n join {out}_rk r on r.t = n.t and r.image_id = n.image_id and r.rk = n.rk + 1)",
        f"{out}_pos as (select t, image_id, unnest(kept).pos pos from (select t, image_id, arg_max(kept, rk) kept "
        f"from {out}_step group by t, image_id))",
        f"{out} as materialized (select p.t, d.* from {source} d join {out}_pos p on d.image_id = p.image_id and d.pos = p.pos)",
    ]


def cte_match(dets: str, truth: str, out: str = "m", threshold: float = 0.5, g: str = "g") -> list[str]:
    """``out(g, image_id, pos, gt_pos, gt_class, iou)``: exclusive greedy matches; both inputs carry ``g``."""
    return [
        f"{out}_rk as materialized (select {g}, image_id, pos, x, y, w, h, row_number() over (partition by {g}, image_id "
        f"order by score desc, pos) rk from {dets})",
        f"{out}_pair as materialized (select * from (select d.{g}, d.image_id, d.rk, d.pos, b.pos gt_pos, b.class_id gt_class, "
        f"{iou('d.', 'b.')} iou from {out}_rk d join {truth} b on d.{g} = b.{g} and d.image_id = b.image_id) "
        f"where iou >= {threshold} and iou > 0)",
        f"{out}_cand as materialized (select d.{g}, d.image_id, d.rk, d.pos, coalesce(p.c, []) c from {out}_rk d left join "
        f"(select {g}, image_id, rk, list(struct_pack(gt_pos := gt_pos, gt_class := gt_class, iou := iou) "
        f"order by iou desc, gt_pos) c from {out}_pair group by all) p on p.{g} = d.{g} and p.image_id = d.image_id and p.rk = d.rk)",
        f"{out}_step({g}, image_id, rk, pos, taken, pick) as ("
        f"select {g}, image_id, rk, pos, case when len(c) > 0 then [c[1].gt_pos] else [] end, c[1] from {out}_cand where rk = 1 "
        f"union all select s.{g}, s.image_id, n.rk, n.pos, "
        f"case when len(list_filter(n.c, lambda e: not list_contains(s.taken, e.gt_pos))) > 0 then "
        f"list_append(s.taken, list_filter(n.c, lambda e: not list_contains(s.taken, e.gt_pos))[1].gt_pos) else s.taken end, "
        f"list_filter(n.c, lambda e: not list_contains(s.taken, e.gt_pos))[1] "
        f"from {out}_step s join {out}_cand n on n.{g} = s.{g} and n.image_id = s.image_id and n.rk = s.rk + 1)",
        f"{out} as materialized (select {g}, image_id, pos, pick.gt_pos gt_pos, pick.gt_class gt_class, pick.iou iou "
        f"from {out}_step where pick is not null)",
    ]


def score_text(eval_type: str) -> str:
    """DuckDB score vector of a detection row ``d``."""
    if eval_type == "class_scores":
        return "d.cs"
    if eval_type == "combined":
        return "list_transform(d.cs, lambda s: s*d.score)"
    return "list_transform(range(20), lambda i: case when i = d.class_id then d.score else cast(0 as double) end)"


def cte_rows(dets: str, truth: str, m: str = "m", out: str = "er", eval_type: str = "combined", g: str = "g") -> list[str]:
    """Evaluation rows: detections with their matched class or -1, then missed boxes with zero vectors."""
    zeros = "list_transform(range(20), lambda i: cast(0 as double))"
    return [
        f"{out} as materialized (select d.{g}, d.image_id, 0 kind, d.score det_score, d.pos, coalesce(m.gt_class, -1) y_true, "
        f"{score_text(eval_type)} scores from {dets} d left join {m} m on m.{g} = d.{g} and m.image_id = d.image_id and m.pos = d.pos "
        f"union all select b.{g}, b.image_id, 1, cast(0 as double), b.pos, b.class_id, {zeros} from {truth} b "
        f"where not exists (select 1 from {m} m where m.{g} = b.{g} and m.image_id = b.image_id and m.gt_pos = b.pos))"
    ]


def cte_curve(rows: str = "er", out: str = "pr", g: str = "g") -> list[str]:
    """Curve points of all 20 classes, later rows first among equal scores."""
    window = (
        f"(partition by {g}, class_id order by score desc, image_id desc, kind desc, det_score asc, pos desc "
        "rows between unbounded preceding and current row)"
    )
    return [
        f"{out}_pt as (select {g}, image_id, kind, det_score, pos, y_true, k.i class_id, scores[k.i + 1] score "
        f"from {rows}, (select cast(unnest(range(20)) as int) i) k)",
        f"{out}_run as (select *, count(*) over {window} rnk, sum(case when y_true = class_id then 1 else 0 end) over {window} tp, "
        f"sum(case when y_true = class_id then 1 else 0 end) over (partition by {g}, class_id) positives from {out}_pt)",
        f"{out} as materialized (select {g}, class_id, rnk, cast(tp as double)/rnk prec, "
        f"case when positives > 0 then cast(tp as double)/positives else cast(0 as double) end recall, score threshold from {out}_run)",
    ]


def cte_ap(curve: str = "pr", out: str = "ap", groups: str = "select distinct g from er", g: str = "g", points: int = 11) -> list[str]:
    """11-point AP of every class of every group, 0 without points."""
    step = 1.0 / (points - 1)
    grid = f"(select case when i = {points - 1} then cast(1 as double) else i * cast({step!r} as double) end r from (select unnest(range({points})) i))"
    return [
        f"{out}_lvl as (select c.{g}, c.class_id, k.r, max(case when c.recall >= k.r then c.prec else 0 end) p from {curve} c, {grid} k group by all)",
        f"{out}_own as (select {g}, class_id, sum(p)/{points} ap from {out}_lvl group by all)",
        f"{out} as materialized (select f.{g}, k.class_id, k.class_name, coalesce(o.ap, cast(0 as double)) ap from ({groups}) f "
        f"cross join fx_classes k left join {out}_own o on o.{g} = f.{g} and o.class_id = k.class_id)",
    ]
