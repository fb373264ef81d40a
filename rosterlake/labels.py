"""Texts that appear in report output.

Fixed values: report readers match on these strings, so they are kept exactly
and in one place.
"""

# Salary against the band of the position.
BELOW_BAND = "Ниже вилки"
ABOVE_BAND = "Выше вилки"
WITHIN_BAND = "В пределах вилки"

# Activity of an employee.
ACTIVE = "Активен"
NOT_ACTIVE = "Не активен"

# Dated project status.
OVERDUE = "Просрочен"
URGENT = "Срочный"
IN_PROGRESS = "В работе"

# Place of a leave in time, and its alert.
PLANNED = "Запланирован"
FINISHED = "Завершен"
CURRENT = "Текущий"
LONG_LEAVE = "Длительный отпуск"
STARTS_SOON = "Скоро начало"
NORMAL = "Норма"

# Components of project cost.
PEOPLE_COST = "Стоимость человеческих ресурсов"
OTHER_COST = "Прочие расходы"

# Metrics of the HR statistics, their units and trends.
NEW_HIRES = "Новых сотрудников"
AVERAGE_SALARY = "Средняя зарплата"
TURNOVER = "Текучесть кадров"
UTILIZATION = "Использование бюджета отделов"
PEOPLE_UNIT = "человек"
MONEY_UNIT = "руб."
PERCENT_UNIT = "%"
UP = "↑ рост"
DOWN = "↓ снижение"
STABLE = "→ стабильно"
TURNOVER_HIGH = "⚠ высокая"
TURNOVER_LOW = "✓ низкая"
TURNOVER_MEDIUM = "→ средняя"
OVERLOADED = "⚠ перегружен"
UNDERLOADED = "✓ недогружен"
OPTIMAL = "→ оптимально"

# Fixed value: payroll above what a department may spend on it.
OVER_BUDGET = "Превышен бюджет отдела"

# Hierarchy texts.
PATH_SEPARATOR = " → "
INDENT = "  "
NO_MANAGER = "Нет руководителя"

# Roles given when projects are staffed.
ROLE_HEAD = "Руководитель проекта"
ROLE_LEADING = "Ведущий специалист"
ROLE_SENIOR = "Старший специалист"
ROLE_OTHER = "Специалист"

# Reasons for rejecting an incoming record.
MISSING_FIELDS = "Отсутствуют обязательные поля"
BAD_EMAIL = "Неверный формат email"
EMAIL_EXISTS = "Email {} уже существует"
NEGATIVE_SALARY = "Зарплата не может быть отрицательной"
EMAIL_USED = "Email уже используется"
NO_SUCH_DEPARTMENT = "Отдел не существует"
NO_SUCH_MANAGER = "Руководитель не существует"
ROW_PREFIX = "Строка {}: "
RAISE_BOUNDS = "Процент повышения должен быть от 0.01 до 100"
RAISE_REASON = "Повышение зарплаты отделу {} на {}%"
# Ours: conditions the database raised in its own words.
BAD_VALUE = "Неверное значение поля"
TABLE_RULE = "Нарушено ограничение таблицы"
