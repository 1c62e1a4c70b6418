"""Evaluation of predicted scene graphs, groundings and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, words

TRIPLET = ["image_id", "subject", "rel", "object"]


def triplet_hits(truth: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """image_id, subject, rel, object, hit and subject_hit (0 or 1) of every true triplet.

    Both sides: image_id, subject, rel, object (labels) and boxes s_x1 ... s_y2, o_x1 ... o_y2. A true triplet is found
    if a prediction agrees in all names and overlaps both boxes enough; its subject if label and box agree.
    """
    box = [f"{e}_{c}" for e in "so" for c in ("x1", "y1", "x2", "y2")]
    t = truth.select(*TRIPLET, *box, F.monotonically_increasing_id().alias("truth_id"))
    p = predicted.select("image_id", "subject", F.col("rel").alias("p_rel"), F.col("object").alias("p_object"), *[F.col(c).alias(f"p_{c}") for c in box])
    near = t.join(p, ["image_id", "subject"], "left").withColumn("subject_ok", F.coalesce(boxes.iou("s_", "p_s_") >= least_iou, F.lit(False)))
    whole = F.col("subject_ok") & F.coalesce((F.col("rel") == F.col("p_rel")) & (F.col("object") == F.col("p_object")) & (boxes.iou("o_", "p_o_") >= least_iou), F.lit(False))
    return near.groupBy("truth_id", *TRIPLET).agg(F.max(whole.cast("int")).alias("hit"), F.max(F.col("subject_ok").cast("int")).alias("subject_hit")).drop("truth_id")


def relation_recall(hits: DataFrame) -> DataFrame:
    """rel, hits, subject_hits and n true triplets of each relation."""
    return hits.groupBy("rel").agg(F.sum("hit").alias("hits"), F.sum("subject_hit").alias("subject_hits"), F.count(F.lit(1)).alias("n"))


def triplet_recall(truth: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """One row: triplet_recall, mean_recall (over relations) and object_recall, in percent; see triplet_hits."""
    return relation_recall(triplet_hits(truth, predicted, least_iou)).agg(
        F.round(100 * F.sum("hits") / F.sum("n"), 6).alias("triplet_recall"), F.round(100 * F.avg(F.col("hits") / F.col("n")), 6).alias("mean_recall"), F.round(100 * F.sum("subject_hits") / F.sum("n"), 6).alias("object_recall")
    )


def recall_at(truth: DataFrame, scored: DataFrame, at: tuple[int, ...] = (20, 50, 100), drop_last: bool = False) -> DataFrame:
    """k, recall and mean_recall of relations among the k best scored options of each image.

    truth(image_id, head, target, rel); scored(image_id, head, target, rel, score). With drop_last the lowest option of
    each image doesn't count.
    """
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "head", "target", "rel")
    ranked = scored.withColumn("place", F.row_number().over(order))
    if drop_last:
        ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image_id"))).where("place < n").drop("n")
    best = ranked.where(F.col("place") <= max(at)).groupBy("image_id", "head", "target", "rel").agg(F.min("place").alias("place"))
    found = truth.join(best, ["image_id", "head", "target", "rel"], "left").select("rel", F.explode(F.array(*[F.lit(k) for k in at])).alias("k"), "place")
    per_rel = found.groupBy("k", "rel").agg(F.count_if(F.col("place") <= F.col("k")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return per_rel.groupBy("k").agg(F.round(100 * F.sum("hits") / F.sum("n"), 6).alias("recall"), F.round(100 * F.avg(F.col("hits") / F.col("n")), 6).alias("mean_recall"))


def best_overlaps(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """image_id, the true box and the largest IoU with a predicted box of its image (null without one)."""
    t = truth.select("image_id", "x1", "y1", "x2", "y2", F.monotonically_increasing_id().alias("box_id"))
    p = predicted.select("image_id", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    return t.join(p, "image_id", "left").groupBy("box_id", "image_id", "x1", "y1", "x2", "y2").agg(F.max(boxes.iou("", "p_")).alias("best")).drop("box_id")


def box_coverage(truth: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """image_id and the share of its true boxes that a predicted box overlaps by more than least_iou; 1 without true boxes."""
    covered = best_overlaps(truth, predicted).groupBy("image_id").agg(F.avg(F.coalesce((F.col("best") > least_iou).cast("double"), F.lit(0.0))).alias("coverage"))
    images = truth.select("image_id").union(predicted.select("image_id")).distinct()
    return images.join(covered, "image_id", "left").select("image_id", F.coalesce("coverage", F.lit(1.0)).alias("coverage"))


def one_per_pair(scored: DataFrame) -> DataFrame:
    """The best scored relation of each ordered pair: what recall with graph constraint ranks."""
    best = F.min(F.struct((-F.col("score")).alias("least"), F.col("rel"))).alias("b")
    return scored.groupBy("image_id", "head", "target").agg(best).select("image_id", "head", "target", F.col("b.rel").alias("rel"), (-F.col("b.least")).alias("score"))


def recall_suite(truth: DataFrame, scored: DataFrame, seen: DataFrame, at: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """metric, k, recall and mean_recall: with ("R") and without ("ngR") graph constraint, and of triplets whose labels seen(subject, rel, object) lacks ("zR", "ng-zR").

    truth(image_id, head, target, rel, subject, object); scored(image_id, head, target, rel, score).
    """
    bound, new = one_per_pair(scored), truth.join(seen, ["subject", "rel", "object"], "left_anti")
    parts = {"R": (truth, bound), "ngR": (truth, scored), "zR": (new, bound), "ng-zR": (new, scored)}
    rows = [recall_at(t, p, at).select(F.lit(name).alias("metric"), "k", "recall", "mean_recall") for name, (t, p) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def accuracy(rows: DataFrame, right: Column, by: str) -> DataFrame:
    """Accuracy of each category and, with a null category, of all."""
    return rows.select(F.col(by).alias("category"), right.cast("int").alias("right")).rollup("category").agg(F.round(F.avg("right"), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pair_accuracy(rows: DataFrame, group: str, right: Column) -> DataFrame:
    """The share of groups whose rows are all right."""
    return rows.groupBy(group).agg(F.bool_and(right).alias("all_right")).agg(F.round(F.avg(F.col("all_right").cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n_groups"))


def judge_ratio(reviews: DataFrame) -> DataFrame:
    """category (null for all) and the mean of the second score in percent of the first; reviews(category, first, second)."""
    means = reviews.rollup("category").agg(F.avg("first").alias("a"), F.avg("second").alias("b"))
    return means.select("category", F.round(F.round("b", 3) / F.round("a", 3) * 100, 2).alias("ratio"))


def category_similarity(rows: DataFrame, text: str, answer: str, vector: str | None = None, answer_vector: str | None = None) -> DataFrame:
    """Mean word overlap and, where vectors are given, mean cosine of answers and truth."""
    parts = [F.round(F.avg(words.word_jaccard(F.col(text), F.col(answer))), 6).alias("word_iou")]
    if vector:
        a, b = F.col(vector), F.col(answer_vector)
        parts.append(F.round(F.avg(words.dot(a, b) / F.sqrt(words.dot(a, a) * words.dot(b, b))), 6).alias("cosine"))
    return rows.agg(*parts)


def referring_accuracy(rows: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """category (null for all): share of boxes with IoU over least_iou, and of right region numbers where there is one.

    rows: category, t_x1 ... t_y2, p_x1 ... p_y2, region_index, pred_region_index.
    """
    hit = F.coalesce(boxes.iou("t_", "p_") > least_iou, F.lit(False)).cast("int")
    same = F.when(F.col("region_index").isNotNull(), (F.col("region_index") == F.col("pred_region_index")).cast("int"))
    return rows.rollup("category").agg(F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(same), 6).alias("region_accuracy"), F.count(F.lit(1)).alias("n"))


def box_summary(rows: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column."""
    x = F.col(value).cast("double")
    quartiles = [F.round(F.percentile(x, q), 6).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return rows.agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev(x), 6).alias("std"), F.min(x).alias("least"), *quartiles, F.max(x).alias("most"))


# Sequential choices within one image: each depends on the last.


def suppressed(scores: np.ndarray, x1, y1, x2, y2, least_iou: float) -> np.ndarray:
    """Indices that non-maximum suppression keeps, best first."""
    size = (x2 - x1) * (y2 - y1)
    order, kept = np.argsort(-scores, kind="stable"), []
    while len(order):
        i, rest = order[0], order[1:]
        kept.append(i)
        w = np.clip(np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]), 0, None)
        h = np.clip(np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]), 0, None)
        order = rest[w * h <= least_iou * (size[i] + size[rest] - w * h)]
    return np.array(kept, int)


def filtered_detections(detections: DataFrame, least_iou: float = 0.5, least_score: float = 0.05, most: int = 100) -> DataFrame:
    """Detections after suppression, a score threshold and the best `most` of each image.

    detections(image_id, obj_idx, det_score, x1, y1, x2, y2). An image's detections are one array, bounded by its detector.
    """
    box = F.struct(-F.col("det_score"), "obj_idx", "x1", "y1", "x2", "y2", "det_score")
    columns = ("det_score", "obj_idx", "x1", "y1", "x2", "y2")
    lists = detections.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("d")).select("image_id", *[F.col(f"d.{c}").alias(c) for c in columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images, numbers, found = [], [], []
            for image_id, scores, idx, *sides in zip(frame["image_id"], *[frame[c] for c in columns], strict=True):
                kept = suppressed(scores, *sides, least_iou)
                kept = kept[scores[kept] > least_score][:most]
                images += [image_id] * len(kept)
                numbers.append(idx[kept])
                found.append(scores[kept])
            yield pd.DataFrame({"image_id": images, "obj_idx": np.concatenate(numbers), "det_score": np.concatenate(found)})

    return lists.mapInPandas(run, "image_id long, obj_idx int, det_score double")


def greedy_assignment(reference: DataFrame, candidates: DataFrame, overwrite: bool = False) -> DataFrame:
    """Repeatedly pair the reference and candidate boxes of an image with the largest IoU: image_id, ref, cand, iou.

    A candidate is used once. With `overwrite` a reference can be taken again by a later candidate, which replaces the
    first; otherwise it is used once too.
    """
    pack = lambda df, name: df.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "x1", "y1", "x2", "y2"))).alias(name))
    both = pack(reference, "refs").join(pack(candidates, "cands"), "image_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for image_id, refs, cands in zip(frame["image_id"], frame["refs"], frame["cands"], strict=True):
                a, b = ([tuple(x.values()) for x in boxes_] for boxes_ in (refs, cands))
                a, b = np.array(a, float), np.array(b, float)
                w = np.clip(np.minimum(b[:, None, 3], a[None, :, 3]) - np.maximum(b[:, None, 1], a[None, :, 1]), 0, None)
                h = np.clip(np.minimum(b[:, None, 4], a[None, :, 4]) - np.maximum(b[:, None, 2], a[None, :, 2]), 0, None)
                size = lambda x: (x[:, 3] - x[:, 1]) * (x[:, 4] - x[:, 2])
                table = w * h / np.maximum(size(b)[:, None] + size(a)[None] - w * h, 1e-9)
                chosen: dict[int, tuple[int, float]] = {}
                while (best := table.max(initial=0.0)) > 0:
                    c, r = np.unravel_index(table.argmax(), table.shape)
                    chosen[int(r)] = (int(c), float(best))
                    table[c] = 0
                    if not overwrite:
                        table[:, r] = 0
                rows += [(image_id, int(a[r, 0]), int(b[c, 0]), s) for r, (c, s) in sorted(chosen.items())]
            yield pd.DataFrame(rows, columns=["image_id", "ref", "cand", "iou"])

    return both.mapInPandas(run, "image_id long, ref int, cand int, iou double")


def grounding(assigned: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: accuracy, mean IoU, share of IoU over 0.5, and accuracy where all boxes of the image are over 0.5.

    assigned(image_id, iou); answers(image_id, right).
    """
    per_image = assigned.groupBy("image_id").agg(F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") > 0.5).cast("int")).alias("good"))
    joined = answers.join(per_image, "image_id", "left")
    right = F.col("right").cast("int")
    return joined.agg(F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("mean_iou"), 6).alias("mean_iou"), F.round(F.avg("good"), 6).alias("over_half"), F.round(F.avg(F.when(F.col("good") == 1, right)), 6).alias("grounded_accuracy"))


_EVALUATORS: dict[str, Callable[..., DataFrame]] = {"triplet_recall": triplet_recall, "recall_at": recall_at, "box_coverage": box_coverage}


def register(name: str) -> Callable:
    """Add an evaluator under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _EVALUATORS:
            raise ValueError(f"evaluator {name} exists")
        _EVALUATORS[name] = f
        return f

    return add


def evaluator(name: str) -> Callable[..., DataFrame]:
    return _EVALUATORS[name]


def evaluators() -> list[str]:
    return sorted(_EVALUATORS)
