"""The projections of ``fixtures`` written again as plain SQL, for checks in another engine."""

from __future__ import annotations

from priceforge.functions.text import EMPTY, MISSING, TWO_LETTERS, accent_table
from priceforge.operators.clean import FLOORS
from priceforge.plans.fixtures import CATEGORIES, MODELS, NAME_STARTS


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def pick(words: list[str], index: str) -> str:
    return f"({_list(words)})[CAST({index} AS INTEGER) + 1]"


_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + " ELSE 'Other' END"

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "line_sums": (
        [],
        """SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n, min(l_partkey) AS pk
        FROM lineitem GROUP BY l_orderkey""",
    ),
    "listings_raw": (
        ["line_sums"],
        f"""SELECT o_orderkey AS id, s.src_seq, o_totalprice * 8 + s.src_seq AS price, qty AS area_m2,
          CASE WHEN o_orderstatus = 'P' THEN 'RENT' ELSE 'SELL' END AS transaction_type,
          CASE WHEN o_orderkey % 10 = 0 THEN 'HOUSE' ELSE 'FLAT' END AS estate,
          n_name AS district, r_name AS neighborhood,
          CAST(52 AS DOUBLE) + CAST(c_custkey % 500 AS DOUBLE) / 1000 AS latitude,
          CAST(20.8 AS DOUBLE) + CAST((c_custkey * 7) % 500 AS DOUBLE) / 1000 AS longitude,
          CASE WHEN n >= 7 THEN 'MORE' ELSE CAST(n AS VARCHAR) END AS rooms_number,
          {pick([*FLOORS, 'ATTIC'], 'o_orderkey % 15')} AS floor_number,
          CASE WHEN o_orderkey % 23 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) END AS building_floors_num,
          CAST(1780 + o_custkey % 260 AS DOUBLE) AS building_year,
          CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS heating,
          c_mktsegment AS building_type,
          CASE WHEN o_orderkey % 13 = 0 THEN '[]' ELSE '[' || p_type || ']' END AS building_material,
          o_custkey % 2 = 0 AS is_private_owner,
          strftime(o_orderdate, '%Y-%m-%d') AS date_created,
          CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pushed_up_at,
          1 AS const_col, CAST(NULL AS DOUBLE) AS all_null_col
        FROM orders
        JOIN (SELECT unnest([0, 1]) AS src_seq) s ON s.src_seq = 0 OR o_orderkey % 49 = 0
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN line_sums ON l_orderkey = o_orderkey
        LEFT JOIN part ON p_partkey = pk""",
    ),
    "listings": (["listings_raw"], "SELECT * FROM listings_raw WHERE src_seq = 0"),
    "market": (
        ["listings"],
        """SELECT *, price / area_m2 AS price_per_m2 FROM listings
        WHERE transaction_type = 'SELL' AND estate = 'FLAT' AND price / area_m2 > 2000 AND area_m2 >= 10""",
    ),
    "panorama": (
        [],
        """SELECT n_name AS district,
          CASE WHEN n_nationkey <> 3 THEN count(c_custkey) END AS pano_pop_total,
          CASE WHEN n_nationkey <> 3 THEN count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) END AS pano_pop_females
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
        WHERE n_nationkey <> 7 GROUP BY n_nationkey, n_name""",
    ),
    "districts": (
        ["panorama"],
        """SELECT district, coalesce(pano_pop_total, 0) AS pano_pop_total,
          coalesce(pano_pop_females, 0) AS pano_pop_females,
          CASE WHEN coalesce(pano_pop_total, 0) <> 0
            THEN CAST(pano_pop_females AS DOUBLE) / pano_pop_total END AS pano_share_pop_females
        FROM panorama""",
    ),
    "derived": (
        ["market"],
        f"""SELECT * REPLACE (
            {' '.join(['CASE floor_number'] + [f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items()] + ['END'])} AS floor_number,
            CASE WHEN building_year BETWEEN 1800 AND 2028 THEN building_year END AS building_year,
            CASE rooms_number WHEN 'MORE' THEN 11 ELSE CAST(rooms_number AS INTEGER) END AS rooms_number,
            CASE building_material WHEN '[]' THEN 'MISSING' ELSE building_material END AS building_material,
            CAST(is_private_owner AS INTEGER) AS is_private_owner),
          2025 - CASE WHEN building_year BETWEEN 1800 AND 2028 THEN building_year END AS building_age,
          sqrt((latitude - 52.2318543::DOUBLE) ** 2 + (longitude - 21.0028622::DOUBLE) ** 2) * 111 AS distance_to_center_km,
          area_m2 / CASE rooms_number WHEN 'MORE' THEN 11 ELSE CAST(rooms_number AS DOUBLE) END AS room_size_m2,
          {' '.join(['CASE floor_number'] + [f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items()] + ['END'])}
            / nullif(building_floors_num, 0) AS floor_ratio
        FROM market""",
    ),
    "outliers": (
        ["derived"],
        """SELECT derived.*,
          """
        + " OR ".join(
            f"coalesce({v} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {v} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), false)"
            for c, v in [
                ("area_m2", "area_m2"),
                ("price", "ln(price)"),
                ("building_floors_num", "building_floors_num"),
                ("price_per_m2", "ln(price_per_m2)"),
                ("room_size_m2", "room_size_m2"),
            ]
        )
        + """ AS outlier
        FROM derived, (SELECT """
        + ", ".join(
            f"quantile_cont({v}, 0.25) AS {c}_q1, quantile_cont({v}, 0.75) AS {c}_q3"
            for c, v in [
                ("area_m2", "area_m2"),
                ("price", "ln(price)"),
                ("building_floors_num", "building_floors_num"),
                ("price_per_m2", "ln(price_per_m2)"),
                ("room_size_m2", "room_size_m2"),
            ]
        )
        + " FROM derived)",
    ),
    "value_counts": (
        ["derived"],
        """SELECT "column", value, count(*) AS n FROM (
            SELECT 'heating' AS "column", heating AS value FROM derived
            UNION ALL SELECT 'building_type', building_type FROM derived
            UNION ALL SELECT 'building_material', building_material FROM derived)
        WHERE value IS NOT NULL GROUP BY "column", value""",
    ),
    "tops": (
        ["value_counts"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk FROM value_counts)
        WHERE rnk <= CASE "column" WHEN 'heating' THEN 4 WHEN 'building_type' THEN 3 ELSE 6 END""",
    ),
    "bucketed": (
        ["outliers", "tops"],
        """SELECT * REPLACE (
          CASE WHEN heating IN (SELECT value FROM tops WHERE "column" = 'heating') THEN heating ELSE 'OTHER' END AS heating,
          CASE WHEN building_type IN (SELECT value FROM tops WHERE "column" = 'building_type')
            THEN building_type ELSE 'OTHER' END AS building_type,
          CASE WHEN building_material IN (SELECT value FROM tops WHERE "column" = 'building_material')
            THEN building_material ELSE 'OTHER' END AS building_material)
        FROM outliers""",
    ),
    "exclude_list": (
        [],
        "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT max(o_orderkey) + 1 FROM orders",
    ),
    "image_features": (
        [],
        f"""SELECT vec_id // 4 * 3 + 1 AS id, {pick(CATEGORIES, 'label')} AS category, embedding AS features
        FROM embeddings""",
    ),
    "image_elements": (
        ["image_features"],
        """SELECT id, category, pos, avg(CAST(features[pos] AS DOUBLE)) AS value
        FROM (SELECT *, unnest(range(1, len(features) + 1)) AS pos FROM image_features)
        GROUP BY id, category, pos""",
    ),
    "img_cat": (
        [],
        """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS img_cat_kitchen,
          CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS img_cat_bathroom
        FROM orders WHERE o_orderkey % 29 <> 0""",
    ),
    "population": (
        ["outliers", "img_cat"],
        """SELECT o.*, coalesce(img_cat_kitchen = 1, false) AS has_img, img_cat_kitchen, img_cat_bathroom
        FROM outliers o LEFT JOIN img_cat USING (id)""",
    ),
    "strata": (
        ["population"],
        """SELECT *, coalesce(CASE WHEN price < 0 THEN NULL WHEN price < 250000 THEN '0-250k'
            WHEN price < 500000 THEN '250-500k' WHEN price < 1000000 THEN '500k-1M'
            WHEN price < 1500000 THEN '1M-1.5M' WHEN price < 2000000 THEN '1.5M-2M'
            WHEN price < 3000000 THEN '2M-3M' ELSE '3M+' END, 'nan')
            || '_' || CASE WHEN has_img THEN 'True' ELSE 'False' END AS stratum
        FROM population WHERE NOT outlier""",
    ),
    "text_values": (
        [],
        """SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN '***' ELSE text END AS text
        FROM documents""",
    ),
    "runs": (
        [],
        f"""SELECT *,
          model || '_rfecv_base_nfeat_' || (user_id % 12) || '_pca_mape_v' || (user_id % 3 + 6) || '_BEST' AS run_name,
          CASE WHEN p_feature_set IS NOT NULL THEN p_feature_set
            WHEN p_feature_set_file IS NOT NULL THEN p_feature_set_file ELSE sets END AS feature_set,
          CASE WHEN p_model_name IS NOT NULL THEN p_model_name
            WHEN model LIKE 'LightGBM%' THEN 'LightGBM' WHEN model LIKE 'XGBoost%' THEN 'XGBoost'
            WHEN model LIKE 'RandomForest%' THEN 'RandomForest' ELSE 'Unknown' END AS model_name,
          coalesce(m_test_final_mape, m_best_optuna_cv_mape) AS test_mape,
          CASE WHEN m_test_final_mape IS NOT NULL THEN 'test_final_mape' ELSE 'best_optuna_cv_mape' END AS test_mape_source,
          {_EPOCH} + to_milliseconds(start_ms) AS start_time,
          {_EPOCH} + to_milliseconds(end_ms) AS end_time
        FROM (SELECT *, event_id AS run_id, user_id % 10 AS experiment_id,
          CASE WHEN user_id % 10 <> 9 THEN 'exp_' || (user_id % 10) ELSE 'Unknown' END AS experiment_name,
          CASE WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
          CASE WHEN event_id % 4 = 0 THEN 'best_run' ELSE 'trial' END AS run_type,
          epoch_us(ts) // 1000 AS start_ms,
          CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) END AS end_ms,
          CASE WHEN event_id % 3 <> 0 THEN model END AS p_model_name,
          CASE WHEN event_id % 4 <> 1 THEN sets END AS p_feature_set,
          CASE WHEN event_id % 8 = 1 THEN sets END AS p_feature_set_file,
          CASE WHEN event_id // 4 % 2 = 0 THEN '50' ELSE '100' END AS n_trials_optuna,
          CASE WHEN event_id % 10 < 7 THEN 'mape' ELSE 'rmse' END AS tuning_scoring_metric,
          CASE WHEN event_id % 6 <> 0 THEN '5' END AS p_cv_folds,
          CAST(value AS VARCHAR) AS p_learning_rate,
          CASE WHEN event_id % 2 = 0 THEN '1e-05' ELSE 'true' END AS p_tolerance,
          CASE WHEN event_id % 11 <> 0 THEN CAST(user_id % 12 + 20 AS VARCHAR) END AS num_selected_features,
          CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE
            CAST(user_id % 12 + 20 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS n_features_selected,
          CASE WHEN event_id % 5 <> 0 THEN value / 1000 END AS m_test_final_mape,
          value / 900 AS m_best_optuna_cv_mape,
          CASE WHEN event_id % 13 <> 0 THEN value / 1100 END AS train_mape,
          value * 10 AS test_rmse,
          1 - value / 500 AS test_r2,
          value AS tuning_duration
        FROM (SELECT *, {_MODEL} AS model,
          'fs_nfeat_' || (user_id % 12) || CASE WHEN user_id % 12 = 11 THEN '_umap' ELSE '' END || '_count' AS sets
        FROM events))""",
    ),
    "finished": (["runs"], "SELECT * FROM runs WHERE run_type = 'best_run' AND status = 'FINISHED'"),
    "summary": (
        ["finished"],
        """SELECT *, TRY_CAST(num_selected_features AS INTEGER) - TRY_CAST(n_features_selected AS INTEGER) AS feature_mismatch,
          TRY_CAST(num_selected_features AS INTEGER) = TRY_CAST(n_features_selected AS INTEGER) AS feature_count_match,
          model_name || '_' || feature_set || '_' || n_trials_optuna || '_' || tuning_scoring_metric AS model_feature_combination,
          CAST(nullif(regexp_extract(run_name, 'v(\\d+)', 1), '') AS INTEGER) AS version,
          replace(replace(feature_set, '_count', ''), 'nfeat_', '') AS feature_set_short
        FROM (SELECT *, row_number() OVER (
            PARTITION BY model_name, feature_set, n_trials_optuna, tuning_scoring_metric
            ORDER BY start_time DESC, run_id) AS rn FROM finished)
        WHERE rn = 1""",
    ),
    "trials": (
        [],
        """SELECT user_id AS study, number,
          CASE WHEN event_id % 8 = 0 OR (user_id % 10 = 0 AND number >= 9) THEN NULL
            WHEN user_id % 7 = 0 THEN value - 50 ELSE value END AS value,
          json_extract_string(props, '$.k') AS k, event_type AS booster
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number FROM events)""",
    ),
    "trial_best": (
        ["trials"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, number) AS rn
          FROM trials WHERE value IS NOT NULL) WHERE rn = 1""",
    ),
    "studies": (
        [],
        f"""SELECT user_id, {pick(list(MODELS.values()), 'user_id % 4')} || '_'
          || CASE WHEN user_id % 11 = 0 THEN 'rfecv_base_pca'
             ELSE 'rfecv_base_poi_nfeat_' || (user_id % 12) || '_pca' END
          || '_u' || user_id || '_mape_v' || (user_id % 3 + 6) || '_study' AS study
        FROM events""",
    ),
    "part_names": (
        [],
        f"""SELECT p_partkey, CASE WHEN start LIKE '%\\_' ESCAPE '\\'
          THEN start || lower(p_type) || '_' || p_size ELSE start END AS feature
        FROM (SELECT *, {pick(NAME_STARTS, f'p_partkey % {len(NAME_STARTS)}')} AS start FROM part)""",
    ),
    "feature_names": (["part_names"], "SELECT DISTINCT feature FROM part_names"),
    "members": (
        ["part_names"],
        """SELECT c_mktsegment AS set_name, feature
        FROM lineitem JOIN part_names ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, feature HAVING avg(l_quantity) > 25.5""",
    ),
    "predictions": (
        [],
        """SELECT o_orderkey AS id, o_totalprice AS true_price,
          o_totalprice * (CAST(1 AS DOUBLE) + CAST((o_orderkey * 37) % 41 - 20 AS DOUBLE) / 100) AS predicted_price
        FROM orders""",
    ),
    "folded": (
        ["predictions"],
        """SELECT *, CAST((row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) - 1) % 5 AS INTEGER) AS fold
        FROM predictions""",
    ),
    "residuals": (
        ["predictions"],
        """SELECT *, true_price - predicted_price AS residual, abs(true_price - predicted_price) AS abs_residual,
          abs(true_price - predicted_price) / nullif(true_price, 0) * 100 AS pct_error FROM predictions""",
    ),
}


def clean(column: str) -> str:
    """SQL of ``clean_text`` for a column."""
    letters, plain = accent_table()
    text = f"lower({column})"
    for letter, pair in TWO_LETTERS.items():
        text = f"replace({text}, '{letter}', '{pair}')"
    text = f"trim(regexp_replace(translate({text}, '{letters}', '{plain}'), '[^a-z0-9_]+', '_', 'g'), '_')"
    return f"CASE WHEN {column} IS NULL THEN '{MISSING}' ELSE coalesce(nullif({text}, ''), '{EMPTY}') END"


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    heads = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    return f"WITH {heads}\n{sql}" if heads else sql
