"""Sales regressors on Spark ML: features, training, evaluation, scoring."""
