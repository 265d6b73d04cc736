"""Column functions, re-exported from the operators that own them."""

from framelake.operators.catalog import contains, filename_timestamp, normalize_collections, normalize_list, padded_bounds, tile_starts
from framelake.operators.jobs import event_level, event_message, progress_number, refinement_relationship
from framelake.operators.scalars import (
    binary_mask,
    candidate_ids,
    expanded_box,
    frame_timestamp,
    gray,
    gray_pixels,
    intersection,
    mask_box,
    merged_json,
    only_value,
    progress,
    roi_encoding,
    setting,
    stores_payload,
    to_bytes_range,
    touched_edges,
    unique_ids,
)

__all__ = [
    "binary_mask", "candidate_ids", "contains", "event_level", "event_message", "expanded_box", "filename_timestamp", "frame_timestamp", "gray", "gray_pixels", "intersection", "mask_box", "merged_json",
    "normalize_collections", "normalize_list", "only_value", "padded_bounds", "progress", "progress_number", "refinement_relationship", "roi_encoding", "setting", "stores_payload", "tile_starts", "to_bytes_range", "touched_edges", "unique_ids",
]
