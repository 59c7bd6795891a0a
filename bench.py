"""Runs the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

import json
import os
import sys
import time

from newsframe.session import local_session
from queries import QUERIES

HEADLINE = ["clean_documents", "tokenize_documents", "stemmed_documents", "article_preset", "top_words_by_class",
            "vocabulary_counts", "vocabulary_reduction", "word_count_summary", "box_plots_by_class", "balanced_split",
            "stratified_batch", "shuffled_positions", "lexicon_sentiment", "corpus_tfidf", "tfidf_unigrams",
            "tfidf_bigrams", "tfidf_trigrams", "padded_sequences", "tfidf_vectors", "logistic_regressions", "naive_bayes",
            "grid_search", "nearest_neighbours", "text_neighbours", "clusters", "incremental_word_counts"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_shape"](spark, folder).collect()  # starts the session outside of the clock
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        # The sink reads every column of every row, so no projection is optimised away.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
