"""Values fixed by the billing formats and by the questions asked of them.

Nothing in this module is logic. Each block is a published name, label or
threshold that results have to agree on.
"""

# Normalized column, slash-style export column, underscore-style
# export column, Spark type of the normalized column.
EXPORT_COLUMNS = (
    ("line_item_id", "identity/LineItemId", "identity_line_item_id", "string"),
    ("usage_start_date", "lineItem/UsageStartDate", "line_item_usage_start_date", "timestamp_ntz"),
    ("usage_end_date", "lineItem/UsageEndDate", "line_item_usage_end_date", "timestamp_ntz"),
    ("billing_period_start", "bill/BillingPeriodStartDate", "bill_billing_period_start_date", "date"),
    ("billing_period_end", "bill/BillingPeriodEndDate", "bill_billing_period_end_date", "date"),
    ("payer_account_id", "bill/PayerAccountId", "bill_payer_account_id", "string"),
    ("usage_account_id", "lineItem/UsageAccountId", "line_item_usage_account_id", "string"),
    ("product_code", "product/ProductCode", "product_product_code", "string"),
    ("product_name", "product/ProductName", "product_product_name", "string"),
    ("region", "product/region", "product_region", "string"),
    ("availability_zone", "lineItem/AvailabilityZone", "line_item_availability_zone", "string"),
    ("usage_type", "lineItem/UsageType", "line_item_usage_type", "string"),
    ("operation", "lineItem/Operation", "line_item_operation", "string"),
    ("resource_id", "lineItem/ResourceId", "line_item_resource_id", "string"),
    ("line_item_type", "lineItem/LineItemType", "line_item_line_item_type", "string"),
    ("unblended_cost", "lineItem/UnblendedCost", "line_item_unblended_cost", "double"),
    ("blended_cost", "lineItem/BlendedCost", "line_item_blended_cost", "double"),
    ("net_unblended_cost", "lineItem/NetUnblendedCost", "line_item_net_unblended_cost", "double"),
    ("usage_amount", "lineItem/UsageAmount", "line_item_usage_amount", "double"),
    ("currency_code", "lineItem/CurrencyCode", "line_item_currency_code", "string"),
    ("line_item_description", "lineItem/LineItemDescription", "line_item_line_item_description", "string"),
    ("billing_entity", "bill/BillingEntity", "bill_billing_entity", "string"),
)

# Normalized columns an export must provide.
MANDATORY_COLUMNS = ("usage_start_date", "line_item_type", "unblended_cost")

# Line-item types that are not usage.
NON_USAGE_TYPES = ("Tax", "Fee", "Credit", "Refund", "BundledDiscount")

# data_source tags of the summary.
EXPORT_SOURCE = "cur"
API_SOURCE = "cost_explorer"

# Billing-API display name, product code.
SERVICE_CODES = (
    ("Amazon Elastic Compute Cloud - Compute", "AmazonEC2"),
    ("Amazon Simple Storage Service", "AmazonS3"),
    ("Amazon Relational Database Service", "AmazonRDS"),
    ("Amazon DynamoDB", "AmazonDynamoDB"),
    ("AWS Lambda", "AWSLambda"),
    ("Amazon CloudFront", "AmazonCloudFront"),
    ("Amazon Elastic Container Service", "AmazonECS"),
    ("Amazon Elastic Kubernetes Service", "AmazonEKS"),
    ("Amazon ElastiCache", "AmazonElastiCache"),
    ("Amazon Redshift", "AmazonRedshift"),
    ("Amazon Kinesis", "AmazonKinesis"),
    ("Amazon SageMaker", "AmazonSageMaker"),
    ("Amazon Simple Notification Service", "AmazonSNS"),
    ("Amazon Simple Queue Service", "AmazonSQS"),
    ("AWS Key Management Service", "awskms"),
    ("Amazon Route 53", "AmazonRoute53"),
    ("Amazon API Gateway", "AmazonApiGateway"),
    ("AWS CloudTrail", "AWSCloudTrail"),
    ("Amazon CloudWatch", "AmazonCloudWatch"),
    ("AWS Config", "AWSConfig"),
    ("AWS Secrets Manager", "AWSSecretsManager"),
    ("Amazon Elastic File System", "AmazonEFS"),
    ("Amazon Elastic Block Store", "AmazonEBS"),
    ("AWS Step Functions", "AWSStepFunctions"),
    ("Amazon Athena", "AmazonAthena"),
    ("AWS Glue", "AWSGlue"),
    ("Amazon OpenSearch Service", "AmazonES"),
    ("Amazon GuardDuty", "AmazonGuardDuty"),
    ("AWS CodeBuild", "AWSCodeBuild"),
    ("Amazon Bedrock", "AmazonBedrock"),
    ("Tax", "Tax"),
)

# API rows whose three costs are all below this are noise.
API_ZERO_COST = 0.001

# Sensitivity label, least absolute robust z that is flagged.
SENSITIVITY = {"low": 3.0, "medium": 2.5, "high": 2.0}
DEFAULT_THRESHOLD = 2.5

# Fixed values of the robust z-score: consistency factor, the spread below
# which a baseline counts as flat, and the score given to a jump off a flat one.
Z_FACTOR = 0.6745
FLAT_MAD = 1e-10
FLAT_Z = 10.0

# Fixed values: (critical above, warning above) for point and trend anomalies.
POINT_SEVERITY = (4.0, 3.0)
DRIFT_SEVERITY = (1.0, 0.5)

# Least present days for a point score and for a drift score.
MIN_POINT_DAYS = 3
MIN_DRIFT_DAYS = 5

# Fixed values of the explanation: days looked at after the anomaly, the factor
# over the median that counts as elevated, usage types reported.
DAYS_AFTER = 7
ELEVATED_FACTOR = 1.5
TOP_USAGE_TYPES = 10

# Words that make an ad-hoc query unsafe.
FORBIDDEN_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE",
    "REPLACE", "MERGE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL", "COPY",
    "ATTACH", "DETACH", "PRAGMA", "SET", "LOAD", "INSTALL",
)

# Spark functions that run arbitrary JVM code from inside a SELECT.
FORBIDDEN_FUNCTIONS = ("reflect", "try_reflect", "java_method")
