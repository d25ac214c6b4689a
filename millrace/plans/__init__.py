"""Jobs over whole tables: recipes, splits, dataset building, profiling, model inputs, metrics."""
