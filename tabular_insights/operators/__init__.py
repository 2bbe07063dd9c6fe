from .bootstrap import BootstrapForest, BootstrapForestModel, bootstrap_draws, poisson
from .categories import (
    bucket_other,
    category_indexer,
    category_labels,
    in_lists,
    index_categories,
    keep_listed,
    keep_top_k,
    ranked_labels,
    top_k_lists,
    top_k_values,
)
from .clean import drop_null_rows, flag_to_int, project
from .depths import cut_predictions, depth_search, score_depths
from .explain import feature_importances, tree_nodes
from .features import assemble, build_pipeline, standardize, vector_columns
from .increments import SKETCH_ERROR, add_source, merged_counts, merged_distincts, merged_top_k, source_state, sources
from .metrics import classification_metrics, confusion_matrix, metrics_of_matrix
from .models import check_bins, fit_forest, fit_mlp, fit_tree, largest_category, score
from .perceptron import forward, layer_weights
from .profile import (
    distinct_counts,
    preview,
    row_counts,
    spread_tally,
    tally,
    value_counts,
)
from .splits import HOLD_OUT, add_folds, hash_split, random_split
from .tuning import (
    Search,
    best_params,
    cross_validate,
    final_report,
    grid_search,
    param_grid,
    select_best,
)
