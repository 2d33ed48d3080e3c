"""Column names and types of a transactions table."""

from pyspark.sql import types as T

LABEL = "isFraud"
FLAG = "isFlaggedFraud"
SENDER = "nameOrig"
RECEIVER = "nameDest"
KIND = "type"
AMOUNT = "amount"
EXCHANGE = "typeEchange"

# The names and types of the data set's columns, in its order.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField(KIND, T.StringType()),
        T.StructField(AMOUNT, T.DoubleType()),
        T.StructField(SENDER, T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField(RECEIVER, T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField(LABEL, T.IntegerType()),
        T.StructField(FLAG, T.IntegerType()),
    ]
)

# The columns only known once the event is over.
BALANCE_COLUMNS = ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")

# What cleaning keeps; account ids and the rule's flag are dropped.
CLEAN_COLUMNS = ("step", KIND, AMOUNT, *BALANCE_COLUMNS, EXCHANGE, LABEL)

# The rule "alert on a transfer above 200 000".
RULE_KIND = "TRANSFER"
RULE_LIMIT = 200_000

# The score thresholds a sweep looks at.
THRESHOLDS = (0.5, 0.3, 0.2, 0.1, 0.05)
