"""Column functions over nested values, JSON text and URLs."""

from nestwright.functions.game import expected_value_of_game
from nestwright.functions.install import install
from nestwright.functions.jsons import json_array_values, json_object_items
from nestwright.functions.lists import list_combinations, list_combinations_to, list_zip
from nestwright.functions.similarity import list_mean_similarity, list_mean_similarity_to, list_similarity, py_list_similarity
from nestwright.functions.urls import url_build, url_query_encode, with_url_query

__all__ = [
    "expected_value_of_game", "install", "json_array_values", "json_object_items", "list_combinations", "list_combinations_to", "list_mean_similarity",
    "list_mean_similarity_to", "list_similarity", "list_zip", "py_list_similarity", "url_build", "url_query_encode", "with_url_query",
]
