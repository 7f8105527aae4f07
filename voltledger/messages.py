"""Texts of outcomes.

Fixed values: users and scripts look for these texts, so they are part of the behaviour.
"""

MISSING_COLUMNS = (
    "Missing the required columns!\n"
    "Missing required columns : {missing}\n"
    "Required columns         : {required}\n"
    "Available columns        : {available}"
)
PATH_NOT_FOUND = 'The parquet file path "{path}" does not exist!'
PLUGIN_IMPORT = "Data import through plugins is not implemented yet!"
INVALID_METHOD = 'Invalid import method "{method}"! Valid methods are: {methods}'

MISSING_VALUES = "Found rows ({n}) with missing values in required columns {cols}!"
DUPLICATE_ROWS = "Found duplicate rows ({n}) over columns: {cols}!"
NOT_AT_START_OF_MONTH = "Found rows ({n}) not at start of month!"
INVALID_FACILITY_TYPE = 'Found facilities ({n}) with invalid values for column "facility_type_code"!'
INVALID_CUSTOMER_TYPE = (
    'Found facility contracts ({n}) with invalid values for column "customer_type_code"!'
)
UNKNOWN_EAN = 'Found facility contracts ({n}) with unknown EAN codes in column "ean"!'
UNRESOLVED_METER_ROWS = (
    'Found rows ({n}) with invalid values for columns "serie_type_code" or "ean"!'
)
NO_IMPORT_INTERVAL = "Could not compute facility contract interval!"

NO_CUSTOMER_GROUPS = "No customer groups exist!"
NO_CONTRACTS = "No facility contracts exist!"
UNKNOWN_STRATEGY = (
    'Missing mapping function for facility customer group mapping strategy "{strategy}"'
)
GROUP_LACKS_PARAMETER = "Required {param} param is None for customer_group_id={group_id}"
UNMAPPED_CONTRACTS = "Facility contracts ({n}) could not be mapped to a customer group!"
DUPLICATE_LINKS = "Found duplicate facility customer group links ({n})!"

INVALID_RELATIVE_POINT = '"{text}" is not a valid relative date point expression'
INVALID_POINT = '"{text}" is not a valid relative or iso-formatted datetime!'
INVALID_INTERVAL = 'Invalid date range expression: "{text}"!'
END_BEFORE_START = "end ({end}) must be >= to start ({start})!"

IMPORTED = "Successfully imported {new} new {noun} and updated {known} existing {noun}!"
IMPORTED_IN_INTERVAL = (
    "Successfully imported {new} new {noun} and updated {known} existing {noun} "
    "in interval {start} - {end}!"
)
METER_DATA_PROCESSED = "Successfully processed meter data for sources: {sources}"
