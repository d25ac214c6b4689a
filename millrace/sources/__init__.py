"""Readers and writers."""

from .readers import (arff, csv, csv_folder, delimited, epoch_column, headerless_csv, json_lines,
                      list_from_text, parquet, parse_list)
from .writers import result_csv, split_summary, split_tables, summary_json

__all__ = ["arff", "csv", "csv_folder", "delimited", "epoch_column", "headerless_csv", "json_lines",
           "list_from_text", "parquet", "parse_list", "result_csv", "split_summary", "split_tables", "summary_json"]
