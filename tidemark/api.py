"""Public entry points, one import away."""

from tidemark.catalog import SCHEMAS, clean as clean_name
from tidemark.functions.scalars import blend_proxy as blend_predictions, map_target_values
from tidemark.operators.align import feature_types, validate as validate_raw_data
from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.conformal import CalibrationQualityError, calibrate, prediction_sets
from tidemark.operators.impute import CorrelationImputer
from tidemark.operators.lifecycle import augment, ingest, train_all, train_industry
from tidemark.operators.matcher import detect_industry, map_columns, similarity_score
from tidemark.operators.models import StackedModel, fit_stack, train_proxy, tune, tune_cv
from tidemark.operators.preprocess import Preprocessor, TypeCaster
from tidemark.operators.serving import predict_record, score_upload
from tidemark.operators.survival import cox_fit
from tidemark.plans.model_queries import industry_dashboard as dashboard

__all__ = [
    "SCHEMAS", "CalibrationQualityError", "CorrelationImputer", "FeatureBridge", "Preprocessor", "StackedModel",
    "TypeCaster", "augment", "blend_predictions", "calibrate", "clean_name", "cox_fit", "dashboard",
    "detect_industry", "feature_types", "fit_stack", "ingest", "map_columns", "map_target_values",
    "predict_record", "prediction_sets", "score_upload", "similarity_score", "train_all", "train_industry",
    "train_proxy", "tune", "tune_cv", "validate_raw_data",
]
