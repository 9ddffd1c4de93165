"""DataFrame operators: queries, statistics, rules, preparation, clustering, evaluation."""
