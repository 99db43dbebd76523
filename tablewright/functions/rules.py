"""Labels, thresholds, keyword lists and calendars.

All of them are defaults of operator parameters; every caller can pass its own.
"""

from __future__ import annotations

# Neutral calendar periods: label, last instant, whether that instant still belongs to it.
PERIODS = [
    ("Pre-COVID baseline", "2020-03-01", False),
    ("COVID shock", "2020-12-31", True),
    ("Early recovery", "2021-12-31", True),
    ("High-rate inflation period", "2023-12-31", True),
    ("Recent period", None, True),
]
UNKNOWN_PERIOD = "Unknown"

# Older three-way administration labels.
ADMINISTRATIONS = [
    ("Pre-Trump", "2017-01-20", False),
    ("Trump (2017-2020)", "2021-01-19", True),
    ("Biden (2021-2024)", "2025-01-19", True),
    ("Post-Biden", None, True),
]

# Named market periods with the direction one would expect: label, start, end, expectation.
MARKET_PERIODS = [
    ("Pre-crisis housing boom", "2004-01-01", "2006-12-31", "Rise"),
    ("Financial-crisis correction", "2007-01-01", "2012-12-31", "Fall"),
    ("Recovery and expansion", "2013-01-01", "2019-12-31", "Rise"),
    ("Pandemic-era demand shock", "2020-01-01", "2021-12-31", "Rise"),
    ("High-rate affordability pressure", "2022-01-01", "2024-12-31", "Mixed"),
]

# Event windows for regime features: name, start, end (None is open).
EVENT_WINDOWS = [
    ("event_covid_shock", "2020-03-01", "2020-12-01"),
    ("event_post_covid", "2021-01-01", None),
    ("event_high_inflation", "2021-04-01", "2023-06-01"),
    ("event_rate_hike_cycle", "2022-03-01", "2023-07-01"),
    ("event_recent_market", "2022-01-01", None),
]
EVENT_START = "2020-03-01"
EVENT_RESUME = "2020-10-01"

# Economic expectations: name, expected sign, keyword groups tried in order.
THEORY_RULES = [
    ("Affordability theory", "Negative", [("mortgage",), ("interest",), ("rate",), ("fed", "funds")]),
    ("Supply-demand theory", "Negative", [("inventory",), ("supply",), ("new", "listing"), ("housing", "supply")]),
    ("Income-demand theory", "Positive", [("income",), ("gdp",), ("wage",), ("earnings",)]),
    ("Labor-market theory", "Negative", [("unemployment",), ("jobless",)]),
]

# Words that make a column name a likely target.
TARGET_WORDS = [
    "target", "label", "outcome", "price", "sales", "revenue", "profit", "score", "value", "index", "churn", "risk",
]

# Use-case templates: category, preferred task, target words.
TEMPLATES = {
    "General Data Project": ("General", "Auto", ["target", "label", "outcome", "score", "value", "index"]),
    "Sales Analysis": (
        "Business", "Regression", ["sales", "revenue", "profit", "amount", "order_value", "quantity", "margin"],
    ),
    "Customer Churn": (
        "Business", "Classification",
        ["churn", "cancelled", "canceled", "retained", "active", "left", "subscription", "renewed"],
    ),
    "Student Performance": (
        "Education", "Auto", ["score", "grade", "exam", "gpa", "pass", "result", "performance", "marks"],
    ),
    "Finance / Risk": (
        "Regulated", "Auto",
        ["risk", "default", "return", "loss", "price", "fraud", "credit", "score", "volatility"],
    ),
    "Health Dataset": (
        "Regulated", "Auto",
        ["diagnosis", "outcome", "risk", "cost", "readmission", "disease", "treatment", "survival"],
    ),
    "Housing Demo": (
        "Demo", "Regression", ["home_price_index", "home price", "price", "hpi", "mortgage", "housing", "inventory"],
    ),
}

# What a column name (in lower case) says about the column, as (kind, pattern).
NAME_RULES = [
    ("time", r"date|time|^month$"),
    ("calendar word", r"date|time|month|year|period"),
    ("calendar name", r"^(date|datetime|timestamp|time|month|year)$"),
    ("derived", r"lag|roll|smooth|pct_change|diff|ratio"),
    ("identifier", r"^(id|uuid|index|row_id|record_id)$|_id$"),
]

# Score bands, highest first.
QUALITY_BANDS = [(0.90, "Excellent"), (0.80, "Strong"), (0.65, "Moderate"), (0.50, "Weak")]
QUALITY_REST = "Very weak"
R2_BANDS = [(0.80, "Strong"), (0.50, "Moderate"), (0.20, "Weak"), (0.0, "Very weak")]
R2_REST = "Worse than baseline"
UNAVAILABLE = "Unavailable"

# Fit diagnoses in report order.
DIAGNOSES = ["Overfitting risk", "Underfitting risk", "Poor generalization", "Reasonable fit", "Model failed"]

# Decision actions: name, weight of the next move, weight of the risk.
ACTIONS = [
    ("Buy / overweight", 1.0, 1.0),
    ("Hold / neutral", 0.45, 0.35),
    ("Wait / underweight", -0.35, 0.15),
]

# Size bands by row count.
SIZE_BANDS = [(5_000_000, "Large"), (100_000, "Medium")]
SIZE_REST = "Small"

# Names in class order for quantile-binned targets.
LEVELS = ["Low", "Medium", "High"]

# Layered storage folders.
LAYERS = [
    "01_raw", "02_intermediate", "03_primary", "04_feature", "05_model_input", "06_models", "07_model_output",
    "08_reporting",
]

# Tuning presets: parameter values for less over- or underfitting.
PRESETS = {
    "RandomForest": {
        "Reduce overfitting": {"n_estimators": 200, "max_depth": 3, "min_samples_leaf": 8, "min_samples_split": 14},
        "Balanced": {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10},
        "Reduce underfitting": {"n_estimators": 500, "max_depth": 12, "min_samples_leaf": 2, "min_samples_split": 4},
    },
    "ExtraTrees": {
        "Reduce overfitting": {"n_estimators": 200, "max_depth": 3, "min_samples_leaf": 8, "min_samples_split": 14},
        "Balanced": {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 10},
        "Reduce underfitting": {"n_estimators": 500, "max_depth": 12, "min_samples_leaf": 2, "min_samples_split": 4},
    },
    "GradientBoosting": {
        "Reduce overfitting": {"n_estimators": 200, "max_depth": 3, "min_samples_leaf": 8, "learning_rate": 0.04, "subsample": 0.75},
        "Balanced": {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 5, "learning_rate": 0.10, "subsample": 0.8},
        "Reduce underfitting": {"n_estimators": 500, "max_depth": 12, "min_samples_leaf": 2, "learning_rate": 0.15, "subsample": 1.0},
    },
    "HistGradientBoosting": {
        "Reduce overfitting": {"max_iter": 250, "learning_rate": 0.03, "max_leaf_nodes": 10, "l2_regularization": 0.2},
        "Balanced": {"max_iter": 350, "learning_rate": 0.05, "max_leaf_nodes": 15, "l2_regularization": 0.05},
        "Reduce underfitting": {"max_iter": 500, "learning_rate": 0.12, "max_leaf_nodes": 31, "l2_regularization": 0.0},
    },
    "ElasticNet": {
        "Reduce overfitting": {"alpha": 0.10, "l1_ratio": 0.35},
        "Balanced": {"alpha": 0.05, "l1_ratio": 0.2},
        "Reduce underfitting": {"alpha": 0.01, "l1_ratio": 0.05},
    },
    "DecisionTree": {
        "Reduce overfitting": {"max_depth": 3, "min_samples_leaf": 10, "min_samples_split": 16, "ccp_alpha": 0.01},
        "Balanced": {"max_depth": 5, "min_samples_leaf": 3, "min_samples_split": 2, "ccp_alpha": 0.0},
        "Reduce underfitting": {"max_depth": 12, "min_samples_leaf": 1, "min_samples_split": 2, "ccp_alpha": 0.0},
    },
    "KNNRegressor": {
        "Reduce overfitting": {"n_neighbors": 12, "weights": "uniform"},
        "Balanced": {"n_neighbors": 5, "weights": "distance"},
        "Reduce underfitting": {"n_neighbors": 3, "weights": "distance"},
    },
    "KNNClassifier": {
        "Reduce overfitting": {"n_neighbors": 12, "weights": "uniform"},
        "Balanced": {"n_neighbors": 5, "weights": "distance"},
        "Reduce underfitting": {"n_neighbors": 3, "weights": "distance"},
    },
    "Ridge": {
        "Reduce overfitting": {"alpha": 10.0},
        "Balanced": {"alpha": 1.0},
        "Reduce underfitting": {"alpha": 0.1},
    },
    "LogisticRegression": {
        "Reduce overfitting": {"C": 0.2},
        "Balanced": {"C": 1.0},
        "Reduce underfitting": {"C": 5.0},
    },
    "SVR": {
        "Reduce overfitting": {"C": 0.5, "epsilon": 0.3},
        "Balanced": {"C": 1.0, "epsilon": 0.1},
        "Reduce underfitting": {"C": 10.0, "epsilon": 0.05},
    },
    "NeuralNetwork": {
        "Reduce overfitting": {"hidden_layers": 1, "hidden_units": 32, "max_iter": 800},
        "Balanced": {"hidden_layers": 2, "hidden_units": 64, "max_iter": 1200},
        "Reduce underfitting": {"hidden_layers": 3, "hidden_units": 128, "max_iter": 1500},
    },
}

# What to try for each diagnosis, by model family (our own short wording).
ADVICE = {
    "Overfitting risk": {
        "tree": "shallower trees, larger leaves, fewer features",
        "boosting": "smaller learning rate, fewer or shallower stages",
        "neighbors": "more neighbors, scaled features",
        "linear": "stronger regularization, fewer correlated features",
        "network": "fewer units or iterations",
        "kernel": "smaller C",
    },
    "Underfitting risk": {
        "tree": "deeper trees, smaller leaves, more trees",
        "boosting": "more stages, larger learning rate",
        "neighbors": "fewer neighbors, distance weights",
        "linear": "weaker regularization, non-linear features",
        "network": "more units or iterations",
        "kernel": "larger C",
    },
    "Poor generalization": {"any": "check time drift, leakage, row count and the split date"},
    "Reasonable fit": {"any": "keep monitoring the gap and the cross-validation spread"},
}
