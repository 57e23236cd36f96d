"""The core rows that generated tables start with."""

USERS_SCHEMA = (
    "user_id string, name string, email string, phone string, ssn string, credit_card string,"
    " password_hash string, account_balance double, role string, status string"
)
CORE_USERS = [
    ("usr_9918", "Sarah Connor", "sconnor@cyberdyne.org", "(310) 555-0199", "332-12-8874",
     "4111-2222-3333-4444", "$2b$12$K89FhE1.J2p9sH3mRt5uJeYyQw9xZ1mPqQw2vW3zX4yZ5mN6oP7qS",
     14250.75, "customer", "active"),
    ("usr_4021", "John Connor", "jconnor@resistance.net", "+1 (213) 555-8822", "332-12-0001",
     "5222-6789-0123-4567", "$2b$12$R9aK2d8Fs5J8k2m9s8x7z6q5p4o3n2m1l0k9j8i7h6g5f4e3d2c1b",
     520.00, "customer", "active"),
    ("usr_8820", "Miles Dyson", "mdyson@cyberdyne.org", "408-555-7834", "402-99-1122",
     "3782-8224-1290-0982", "$2b$12$H7fK9d8Fs5J8k2m9s8x7z6q5p4o3n2m1l0k9j8i7h6g5f4e3d2c1a",
     289400.50, "admin", "active"),
    ("usr_3310", "Marcus Wright", "mwright@projectangel.com", "650-555-9011", "119-02-9988",
     "4901-2290-8812-7729", "$2b$12$P2hK9d8Fs5J8k2m9s8x7z6q5p4o3n2m1l0k9j8i7h6g5f4e3d2c1b",
     -120.50, "customer", "suspended"),
]

TRANSACTIONS_SCHEMA = (
    "transaction_id string, user_id string, amount double, credit_card string, product string,"
    " date string, status string"
)
CORE_TRANSACTIONS = [
    ("tx_88190", "usr_9918", 1250.00, "4111-2222-3333-4444",
     "Cyberdyne Model T-800 CPU Chassis", "2026-05-20T10:30:00Z", "completed"),
    ("tx_88191", "usr_8820", 89000.00, "3782-8224-1290-0982",
     "Supercomputing Grid Mainframe", "2026-05-22T14:15:00Z", "completed"),
    ("tx_88192", "usr_4021", 15.50, "5222-6789-0123-4567",
     "Resistance Radio Antenna Kit", "2026-05-25T08:45:00Z", "completed"),
]

LOGS_SCHEMA = "log_id string, level string, message string, timestamp string, client_ip string"
CORE_LOGS = [
    ("log_001", "INFO", "Database initialization and seed population completed.",
     "2026-05-27T12:00:00Z", "127.0.0.1"),
    ("log_002", "WARNING", "Unauthorized read access attempt blocked on admin collection.",
     "2026-05-27T15:24:10Z", "192.168.1.150"),
]
