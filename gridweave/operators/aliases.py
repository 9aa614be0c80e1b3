"""Older spellings, kept as thin names of the operators they stand for."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from gridweave.operators import filters, graph, labels, morphology, pointwise

_BOTH = {
    "maximum": filters.maximum_filter, "minimum": filters.minimum_filter, "mean": filters.mean_filter, "median": filters.median, "mode": filters.mode,
    "variance": filters.variance_filter, "standard_deviation": filters.standard_deviation, "bottom_hat": filters.bottom_hat, "top_hat": filters.top_hat,
    "closing": filters.grayscale_closing, "opening": filters.grayscale_opening, "dilate": None, "erode": None,
}
_DIAMOND = {
    "laplace": filters.laplace, "nonzero_maximum": morphology.nonzero_maximum, "nonzero_minimum": morphology.nonzero_minimum,
    "onlyzero_overwrite_maximum": morphology.onlyzero_overwrite_maximum,
}

ALIASES: dict[str, Callable] = {}
for _name, _op in _BOTH.items():
    if _op is not None:
        for _kind in ("box", "sphere"):
            ALIASES[f"{_name}_{_kind}"] = partial(_op, connectivity=_kind)
for _name, _op in _DIAMOND.items():
    ALIASES[f"{_name}_box"] = partial(_op, connectivity="box")
    ALIASES[f"{_name}_diamond"] = partial(_op, connectivity="sphere")


def _plain(op: Callable, kind: str) -> Callable:
    def run(src):
        return op(src, 1, 1, 1, kind)

    return run


ALIASES |= {
    "dilate_box": _plain(morphology.binary_dilate, "box"), "dilate_sphere": _plain(morphology.binary_dilate, "sphere"),
    "erode_box": _plain(morphology.binary_erode, "box"), "erode_sphere": _plain(morphology.binary_erode, "sphere"),
    "detect_maxima_box": partial(filters.detect_maxima, connectivity="box"), "detect_minima_box": partial(filters.detect_minima, connectivity="box"),
    "replace_intensity": pointwise.replace_value, "replace_intensities": labels.replace_values,
    "average_distance_touching_neighbors": graph.mean_distance_touching_neighbors,
    "average_distance_of_n_nearest_distances": graph.mean_distance_n_nearest_neighbors,
    "maximum_distance_of_n_shortest_distances": graph.maximum_distance_n_nearest_neighbors,
    "average_distance_of_n_far_off_distances": graph.mean_distance_n_farthest_neighbors,
    "generate_touch_portion_within_range_neighbors_matrix": graph.generate_partial_touching_area_matrix_within_range,
    "generate_touch_count_matrix": graph.generate_touching_area_matrix,
    "statistics_of_labelled_pixels": lambda intensity=None, label=None: labels.labels_statistics(label, intensity),
    "statistics_of_background_and_labelled_pixels": lambda intensity=None, label=None: labels.labels_statistics(label, intensity, True),
    "read_intensities_from_map": lambda labels_, map_: labels.read_map_values(map_, labels_),
    "label_mean_intensity_map": labels.mean_intensity_map, "label_pixel_count_map": labels.pixel_count_map,
    "exclude_labels": labels.remove_labels, "exclude_labels_on_edges": labels.remove_labels_on_edges,
    "exclude_labels_outside_size_range": labels.filter_label_by_size,
    "exclude_labels_with_map_values_out_of_range": labels.remove_labels_with_map_values_out_of_range,
    "exclude_labels_with_map_values_within_range": labels.remove_labels_with_map_values_within_range,
    "generate_touch_portion_matrix": graph.generate_partial_touching_area_matrix,
    "connected_components_labeling": labels.connected_component_labeling,
    "standard_deviation_touch_portion": graph.standard_deviation_partial_touching_area_matrix,
    "statistics_of_labelled_neighbors": graph.labels_neighbors_statistics,
}
globals().update(ALIASES)
__all__ = [*ALIASES]
