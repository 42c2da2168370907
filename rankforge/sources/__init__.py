from .json_parts import json_array_elements
from .readers import load_csv, load_json_array, load_many, load_parquet, load_table
from .tables import (content_items, embedding_vectors, event_ratings, item_titles, items, ratings,
                     ratings_agg, table)
from .writers import (load_model_tables, save_item_features, save_json_arrays, save_long_matrix, save_many,
                      save_model_tables, save_table)

__all__ = [
    "json_array_elements", "load_csv", "load_json_array", "load_many", "load_parquet", "load_table",
    "content_items", "embedding_vectors", "event_ratings", "item_titles", "items", "ratings",
    "ratings_agg", "table",
    "load_model_tables", "save_item_features", "save_json_arrays", "save_long_matrix", "save_many",
    "save_model_tables", "save_table",
]
