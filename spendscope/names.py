"""Column names, labels and constants the reports depend on.

They are part of the data contract (sheet headers, report headers, business
constants), so they are kept together here as plain text.
"""

# -- merchants, suffixes, currencies ---------------------------------------
SUFFIXED_MERCHANT = 569301767
MAIN_MERCHANT = 9174985
HOME_SUFFIX = "-hm"
SUFFIX_LENGTH = 3
FOREIGN_CURRENCY = "HKD"
REPORT_CURRENCY = "USD"
FX_RATE = 0.127
FX_RATE_SKU_PAGE = 0.13

# -- listing generations ---------------------------------------------------
NEW_MARK = "2023"
OLD_MARK = "2022"
NEW_LISTING = "2023新品"
OLD_LISTING = "老品"

# -- columns ---------------------------------------------------------------
PT1, PT2, PT3 = "Product Type 1", "Product Type 2", "Product Type 3"
GENERATION = "old_or_new"
PRICE = "Sale Price"
ADS_MEASURES = ("impression", "cost", "click", "conversions", "ads value")
CAMPAIGN_ADS_MEASURES = ("Impression", "cost", "clicks", "conversion", "value")
SENSOR_MEASURES = ("Sale", "GMV", "AddtoCart", "UV")
CAMPAIGN_SENSOR_MEASURES = ("saleuser", "sale", "GMV", "AddtoCart", "UV")

# -- sheet headers -> canonical names --------------------------------------
LABEL_HEADERS = {"SKU ID": "SKU"}
SENSOR_DAILY_HEADERS = {"日期": "Date", "销量": "Sale", "加购": "AddtoCart"}
SENSOR_MONTHLY_HEADERS = {"月": "Month", "销量": "Sale", "加购": "AddtoCart"}
SENSOR_CAMPAIGN_HEADERS = {"行为时间": "Date"}

# -- report headers --------------------------------------------------------
SENSOR_ROI = "神策ROI"
ADS_ROI = "ads ROI"
CPC = "CPC"
CTR = "CTR"
CONVERSION = "神策转化率"
ADD_TO_CART = "神策加购率"
DATE_RANGE = "日期范围"
RANGE_JOINER = "至"
CHANGE_ROW = "对比"
TOTAL_CTR = "点击率"
TOTAL_SENSOR_ROI = "神策 ROI"
YEAR_SENSOR_ROI = "Sensor ROI"
IMAGE = "图片"

DAILY_MEAN_LABELS = {
    "cost": "日均费用", "click": "日均点击", "GMV": "日均GMV",
    "ads value": "日均ads value", "conversions": "日均ads转化",
    "Sale": "日均销量", "AddtoCart": "日均加购", "impression": "日均展示",
    "UV": "日均UV",
}
REPORT_LABELS = {
    "cost": "费用", "click": "点击", "conversions": "ads转化", "Sale": "销量",
    "AddtoCart": "加购", "impression": "展示",
}
SKU_REPORT_LABELS = {
    "cost": "费用", "click": "点击", "conversions": "ads转化", "sale": "销量",
    "saleuser": "支付用户数", "AddtoCart": "加购", "impression": "展示",
}
MONTH_REPORT = ("日均费用", "日均点击", "日均GMV", "日均ads value", "神策ROI", "ads ROI",
                "日均销量", "CPC", "CTR", "神策转化率", "神策加购率", "日均展示")
DAY_REPORT = ("费用", "点击", "GMV", "ads value", "神策ROI", "ads ROI", "销量", "CPC",
              "CTR", "神策转化率", "神策加购率", "展示", "UV")
PERIOD_MEASURES = ("支付用户数", "销量", "GMV", "UV", "加购", "展示", "费用", "点击",
                   "ads转化", "ads value")
PERIOD_RATIOS = ("神策转化率", "神策加购率", "点击率", "ads ROI", "神策 ROI", "CPC")

# -- text layout of the reports: 2 = two decimals, % = percent, r = as is ---
TOTAL_TEXT = {
    "费用": "2", "点击": "2", "GMV": "2", "ads value": "2", "神策 ROI": "2",
    "ads ROI": "2", "销量": "r", "CPC": "2", "点击率": "%", "神策转化率": "%",
    "神策加购率": "%", "支付用户数": "r", "UV": "r", "加购": "r", "展示": "r",
    "ads转化": "2",
}
SKU_TEXT = {
    "费用": "2", "点击": "r", "GMV": "2", "ads value": "2", "神策ROI": "2",
    "ads ROI": "2", "ads转化": "2", "销量": "r", "CPC": "2", "CTR": "%",
    "神策转化率": "%", "神策加购率": "%", "加购": "r", "UV": "r", "支付用户数": "r",
}
RANGE_TEXT = {
    "费用": "2", "点击": "2", "GMV": "2", "ads value": "2", "神策ROI": "2",
    "ads ROI": "2", "销量": "2", "CPC": "2", "CTR": "%", "神策转化率": "%",
    "神策加购率": "%",
}
YEAR_TEXT = {
    "cost": "2", "GMV": "2", "Sale Price": "2", "Sale": "r", "ads value": "2",
    "Sensor ROI": "2", "ads ROI": "2", "CTR": "%",
}

# -- bands and calendar ----------------------------------------------------
COST_LOW, COST_MID = 50, 150
ROI_WEAK, ROI_STRONG = 1.5, 2.5
MEAN_FIRST_MONTH, MEAN_LAST_MONTH = "2023-01-01", "2024-01-01"
YEAR_FIRST_MONTH, YEAR_LAST_MONTH = "2023-01-01", "2023-12-01"

# -- SKU pruning plan --------------------------------------------------------
PRUNING_MONTHS = ("2023-01-01", "2023-12-01")
PRUNING_RETURN_MONTHS = ("2023-01-01", "2023-11-01")
PRUNING_TREND_MONTHS = ("2023-07-01", "2023-12-01")
PRUNING_COST_ABOVE, PRUNING_GMV_BELOW, PRUNING_RETURN_BELOW = 50.0, 5000.0, 2.0
PRUNING_LEAST_SKUS = 2
PRUNING_CATEGORIES = ("daybed", "dining table", "tv stand")
PRUNING_LEFT_OUT = ("outdoor",)
