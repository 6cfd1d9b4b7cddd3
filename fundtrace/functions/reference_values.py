"""Values that results depend on; they are data, not logic."""

# Payment currency names and their ISO codes.
CURRENCY_ISO = {
    "US Dollar": "USD", "Euro": "EUR", "UK Pound": "GBP", "Yen": "JPY", "Swiss Franc": "CHF",
    "Canadian Dollar": "CAD", "Australian Dollar": "AUD", "Mexican Peso": "MXN", "Brazil Real": "BRL",
    "Yuan": "CNY", "Rupee": "INR", "Ruble": "RUB", "Saudi Riyal": "SAR", "Shekel": "ILS",
    "Swedish Krona": "SEK", "New Zealand Dollar": "NZD", "Singapore Dollar": "SGD",
    "Hong Kong Dollar": "HKD", "Norwegian Krone": "NOK", "South Korean Won": "KRW",
    "Turkish Lira": "TRY", "South African Rand": "ZAR", "Thai Baht": "THB", "Polish Zloty": "PLN",
    "Czech Koruna": "CZK", "Philippine Peso": "PHP", "Indonesian Rupiah": "IDR",
    "Malaysian Ringgit": "MYR", "Hungarian Forint": "HUF", "Icelandic Krona": "ISK",
    "Croatian Kuna": "HRK", "Romanian Leu": "RON", "Danish Krone": "DKK", "Bulgarian Lev": "BGN",
    "Bitcoin": "BTC",
}

# Units of each currency for one US dollar, by day.
RATE_CODES = ["AUD", "BRL", "CAD", "CHF", "CNY", "EUR", "GBP", "ILS", "INR", "JPY", "MXN", "RUB", "SAR", "USD", "BTC"]
DAILY_RATES = {
    "2022-09-01": [1.4644, 5.1805, 1.314, 0.97999, 6.9, 1.0002, 0.86272, 3.3535, 79.543, 139.34, 20.189, 60.367, 3.75, 1.0, 19793.1],
    "2022-09-02": [1.4691, 5.2035, 1.3141, 0.98175, 6.9035, 1.0011, 0.86468, 3.3755, 79.719, 140.11, 20.085, 60.427, 3.75, 1.0, 199999.0],
    "2022-09-03": [1.4691, 5.2056, 1.3138, 0.98207, 6.9046, 1.0013, 0.86478, 3.3791, 79.75, 140.17, 20.081, 60.471, 3.75, 1.0, 19831.4],
    "2022-09-04": [1.4695, 5.2082, 1.3139, 0.98219, 6.9047, 1.0013, 0.8649, 3.3815, 79.754, 140.22, 20.084, 60.461, 3.75, 1.0, 19952.7],
    "2022-09-05": [1.4722, 5.1786, 1.3142, 0.98273, 6.9216, 1.0068, 0.86813, 3.4006, 79.816, 140.49, 20.018, 60.737, 3.75, 1.0, 20126.1],
}

# The windows compare raw timestamp text, so a bare date sorts before any time on that date.
BASELINE_WINDOW = ("2022/09/01", "2022/09/06")
CANDIDATE_WINDOW = ("2022/09/06", "2022/09/15")
CONVERSION_DAYS = ("2022-09-01", "2022-09-05")
SMALL_AMOUNT = 50.0
AVERAGE_DIVISOR = 100.0
FAN_OUT_ABOVE = 5
PATHS_ABOVE = 5
