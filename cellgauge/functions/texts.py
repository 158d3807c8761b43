"""Domains, thresholds and message texts that results must show."""

# Device types that raise no warning.
KNOWN_DEVICES = [
    "Mobile",
    "Tablet",
    "Laptop",
    "Desktop",
    "IoT",
    "IoT Device",
    "Feature Phone",
    "Smartphone",
]

# Location types.
URBAN, RURAL, UNKNOWN = "Urban", "Rural", "Unknown"
KNOWN_LOCATIONS = [URBAN, RURAL]

# Validation messages, %d is the number of rows.
MSG_NULLS = "Column '{name}' has %d missing values"
MSG_SIGNAL = "Signal Strength values should be between -150 and 0 dBm. Found %d invalid values"
MSG_TRAFFIC = "Network Traffic should be positive. Found %d negative values"
MSG_LATENCY = "Latency should be positive. Found %d non-positive values"
MSG_USERS = "User Count should be non-negative. Found %d negative values"
MSG_DEVICE = "Found %d potentially invalid device types"
MSG_LOCATION = "Location Type should be 'Urban' or 'Rural'. Found %d invalid values"
MSG_DUPLICATES = "Found %d duplicate Tower IDs"

# Interpretation of the best R2.
TIER_TEXTS = {
    "excellent": "Excellent model performance achieved with R² > 0.8",
    "good": "Good model performance achieved with R² > 0.6",
    "moderate": "Moderate model performance achieved with R² > 0.4",
    "below": "Model performance is below expectations with R² < 0.4",
}
VARIATION_TEXT = (
    "Significant performance variation between models suggests model choice is critical"
)
SIMILAR_TEXT = "Similar performance across models suggests consistent predictive capability"
BEST_TYPE_TEXT = "Best performing model type: %s"
SIGNIFICANT_TEXT = "%d/%d model comparisons show statistically significant differences"
NOT_SIGNIFICANT_TEXT = "No statistically significant differences found between models"

# Recommendations.
RECOMMENDED_TEXT = "Recommended model: %s (%s)"
IMPROVE_TEXT = "Consider feature engineering or ensemble methods to improve performance"
HIGH_MAPE_TEXT = "High MAPE values detected - review prediction accuracy for business impact"
MANY_MODELS_TEXT = (
    "Multiple models show similar performance - consider computational efficiency in final "
    "selection"
)

# Verdict of a significance test.
VERDICT_SIGNIFICANT = (
    "The performance difference is statistically significant (p=%.4f < %s). "
    "%s performs significantly better than %s."
)
VERDICT_NOT_SIGNIFICANT = (
    "The performance difference is not statistically significant (p=%.4f >= %s). "
    "There is no significant difference between the models."
)

# Deployment advice by tier, architecture and fusion advice.
DEPLOY_READY = "Model is ready for production deployment"
DEPLOY_GOOD = "Model shows good performance for deployment"
DEPLOY_NOT_READY = "Model needs significant improvement before deployment"
ADOPT_VERTICAL = "Adopt vertical partitioning approach"
ADOPT_MONOLITHIC = "Consider monolithic approach for simplicity"
ENHANCE_META = "Explore advanced ensemble methods"
ENHANCE_SIMPLE = "Simple weighted averaging is sufficient"

# Insights on segment models.
BEST_SEGMENT_TEXT = "%s specialized model achieved best overall performance"
BEST_GLOBAL_TEXT = "Global model outperformed specialized geographical models"
SEGMENT_GAIN_TEXT = "%s specialization effective: %.1f%% improvement"
SEGMENT_LIMITED_TEXT = "%s specialization shows limited benefit"
