"""Table operators: evidence, merging, ranking, crawling, resolving, tasks, exports."""
